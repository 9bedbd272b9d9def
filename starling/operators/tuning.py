"""Weight grids, objectives, seeded search and resumable trial logs."""

from __future__ import annotations

import random
from math import exp, log
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import clip
from .evaluation import ranking_metrics


def weight_grid(step: float = 0.1, least_quality: float = 0.5) -> list[dict[str, float]]:
    """Distinct (mf, cf, quality) weights that add up to 1, with quality of at least least_quality."""
    n = round(1 / step)
    rows = {(round(a * step, 4), round(b * step, 4), round(1 - (a + b) * step, 4)) for a, b in product(range(n + 1), repeat=2) if a + b <= n}
    return [dict(zip(("mf", "cf", "quality"), r)) for r in sorted(rows) if r[2] >= least_quality - 1e-9]


def _grid_table(mixed: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """mixed(weight, user_id, item_id, score) -> precision and hit rate of every weight, in one job."""
    order = Window.partitionBy("weight", "user_id").orderBy(F.desc(F.round("score", 8)), "item_id")
    best = mixed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    hits = best.join(relevant.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left").fillna({"hit": 0})
    by = hits.join(relevant.select("user_id").distinct(), "user_id", "left_semi").groupBy("weight", "user_id").agg(F.sum("hit").alias("hits"))
    return by.groupBy("weight").agg(F.round(F.avg(F.col("hits") / k), 6).alias("precision_at_k"), F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate_at_k")).orderBy("weight")


def _accepted(table: DataFrame, gain: float) -> float:
    """The best weight if its precision is at least `gain` above the least weight's and its hit rate no worse; else the least weight."""
    rows = table.collect()  # one row for each weight
    best = max(rows, key=lambda r: (r.precision_at_k, r.hit_rate_at_k, -r.weight))
    ok = best.precision_at_k - rows[0].precision_at_k >= gain and best.hit_rate_at_k >= rows[0].hit_rate_at_k
    return best.weight if ok else rows[0].weight


def _with_grid(scored: DataFrame, weights: list[float]) -> DataFrame:
    return scored.crossJoin(F.broadcast(scored.sparkSession.createDataFrame([(w,) for w in weights], "weight double")))  # a fixed grid


def tune_blend(scored: DataFrame, relevant: DataFrame, k: int, steps: int = 21, gain: float = 0.0125) -> tuple[float, DataFrame]:
    """scored(user_id, item_id, learned, base) -> the accepted weight of the learned score, and the table of all weights from 0 to 1."""
    mixed = _with_grid(scored, [i / (steps - 1) for i in range(steps)])
    table = _grid_table(mixed.withColumn("score", F.col("weight") * F.col("learned") + (1 - F.col("weight")) * F.col("base")), relevant, k)
    return _accepted(table, gain), table


def tune_residual(scored: DataFrame, relevant: DataFrame, k: int, most: float = 0.3, steps: int = 7, gain: float = 0.0) -> tuple[float, DataFrame]:
    """scored(user_id, item_id, base, residual) -> the accepted share of the residual that is added to the base score, and the table of all."""
    mixed = _with_grid(scored, [most * i / (steps - 1) for i in range(steps)])
    table = _grid_table(mixed.withColumn("score", clip(F.col("base") + F.col("weight") * F.col("residual"), 0.0, 1.0)), relevant, k)
    return _accepted(table, gain), table


def ranking_objective(m: dict) -> float:
    return m["precision_at_k"] + 0.25 * m["map_at_k"] + 0.10 * m["hit_rate_at_k"] - 0.25 * max(0.08 - m["catalog_coverage"], 0.0)


def least_reachable(least: float, limit: int, relevant: int) -> float:
    """The recall asked for, or nearly all that a pool of `limit` items can have."""
    return min(least, 0.95 * min(limit / max(relevant, 1), 1.0))


def recall_objective(m: dict, least: float, limit: int, relevant: int) -> float:
    """Below 0 if recall misses the least that the pool can reach, above it otherwise."""
    least = least_reachable(least, limit, relevant)
    if m["route_recall"] < least:
        return (m["route_recall"] - least) - 0.05 * (least - m["route_recall"])
    return m["route_precision"] + 0.25 * m["route_marginal_recall_sum"] + 0.10 * m["route_recall"]


# The search ranges; of the recall routes, a floor, what the cap adds to it, and the base weight.
ROUTE_RANGES = {
    "popular_quality": ((0.12, 0.45), (0.04, 0.40), (0.75, 1.80)),
    "mf_user_top": ((0.12, 0.85), (0.10, 0.75), (0.55, 1.70)),
    "profile_centroid": ((0.12, 0.95), (0.10, 0.85), (0.45, 1.80)),
    "item_item_cf": ((0.08, 0.75), (0.08, 0.65), (0.45, 1.80)),
    "user_user_cf": ((0.05, 0.55), (0.05, 0.45), (0.35, 1.40)),
    "year_affinity": ((0.10, 0.85), (0.10, 0.75), (0.45, 1.80)),
}
SPACES = {
    "hybrid": {"mf": (0.05, 0.45), "cf": (0.0, 0.15)},
    "mf": {"factors": range(24, 129, 8), "iterations": range(10, 41, 5), "reg": (1e-3, 1e-1)},
    "recall": {"rrf_k": (20.0, 140.0)} | {f"{s}_{name}": r for s, ranges in ROUTE_RANGES.items() for name, r in zip(("floor", "cap_extra", "base_weight"), ranges)},
}
LOGARITHMIC = {"reg"}


def trials(mode: str, n: int, seed: int = 42) -> list[dict]:
    """n settings of a mode's space by a seeded generator; the first m of any longer list are the same."""
    rng = random.Random(f"{mode}-{seed}")

    def drawn(name: str, values):
        if isinstance(values, range):
            return rng.choice(values)
        if name in LOGARITHMIC:
            return round(exp(rng.uniform(log(values[0]), log(values[1]))), 6)
        return round(rng.uniform(*values), 6)

    return [{"trial_id": f"{mode}-{seed}-{i}"} | {k: drawn(k, v) for k, v in SPACES[mode].items()} for i in range(n)]


def run_trials(spark: SparkSession, settings: list[dict], evaluate: Callable[[dict], dict | list[dict]], folder: str) -> DataFrame:
    """Evaluates the settings whose trial_id the log lacks and appends what it gives, a row or several; returns the whole log."""
    try:
        done = {r.trial_id for r in spark.read.parquet(folder).select("trial_id").collect()}  # one row for each trial
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    for s in settings:
        if s["trial_id"] not in done:
            found = evaluate(s)
            rows = [{k: v for k, v in (s | r).items() if v is not None} for r in (found if isinstance(found, list) else [found])]
            every = None
            for row in rows:  # rows may differ in their columns
                one = spark.createDataFrame([row])
                every = one if every is None else every.unionByName(one, allowMissingColumns=True)
            every.coalesce(1).write.mode("append").parquet(folder)  # at once, so that a trial is whole or missing
    return spark.read.option("mergeSchema", True).parquet(folder)


def evaluate_weights(features: DataFrame, relevant: DataFrame, weights: dict[str, float], k: int, catalogue: int) -> dict:
    """Metrics of features(user_id, item_id, mf, cf, quality) ranked by a weighted sum."""
    score = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round(score, 8)), "item_id")
    return ranking_metrics(features.withColumn("rank", F.row_number().over(order)), relevant, k, catalogue).first().asDict()
