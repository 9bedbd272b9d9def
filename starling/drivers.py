"""Offline runs: learning to rank, resumable searches of settings, and comparisons of recommenders."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions.numeric import min_max, top
from .operators import candidates, collaborative as cf, evaluation as ev, factors, recall, rerank, selection, tuning
from .pipelines import Dataset
from .sources import files
from .sources.steps import written

# The grids, and how many users each stage of a search evaluates.
MF_GRID = [{"factors": f, "iterations": n, "reg": 0.04 if n <= 20 else 0.05} for f in (32, 48, 64, 96) for n in (15, 20, 30)]
WEIGHTS = [
    (0.10, 0.00, 0.90), (0.15, 0.00, 0.85), (0.20, 0.00, 0.80), (0.25, 0.00, 0.75), (0.30, 0.00, 0.70),
    (0.20, 0.05, 0.75), (0.25, 0.05, 0.70), (0.30, 0.05, 0.65), (0.35, 0.10, 0.55), (0.50, 0.30, 0.20),
]
MORE_MF, MORE_CF = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40), (0.00, 0.03, 0.05, 0.08, 0.10)


@dataclass(frozen=True)
class SearchPlan:
    """Users of each stage of large_search()."""

    scale: tuple[int, ...] = (160, 500, 1000)
    mf: int = 500
    hybrid: int = 500
    pool: int = 1200


SMOKE = SearchPlan((40,), 40, 40, 300)


@dataclass(frozen=True)
class Learning:
    """Settings of learn(): how negatives are drawn, how scores are blended, and which rankers are evaluated beside the stacked one."""

    negatives: str = "hybrid_hard"
    per_positive: int = 8
    blend: str = "value"
    least_gain: float = 0.0125
    neural: bool = False
    pairwise: bool = True
    residual: bool = True
    mmr: bool = True
    rrf_k: float = 60.0
    priors: tuple[tuple[str, float, float, float], ...] = ()
    factors: factors.Config = factors.Config()

    def own_priors(self) -> dict[str, recall.Prior]:
        return recall.PRIORS | {p[0]: recall.Prior(*p[1:]) for p in self.priors}


def last_ratings(data: Dataset) -> DataFrame:
    """One rating for each user and item, the last."""
    return data.ratings.groupBy("user_id", "item_id").agg(F.max_by("rating", "ts").alias("rating"), F.max("ts").alias("ts"))


class Split:
    """A time split of a dataset and what every evaluator on it shares."""

    def __init__(self, data: Dataset, config: ev.Config):
        self.config, self.items = config, data.items
        rows = written(ev.time_split(last_ratings(data), config.test_ratio, config.min_ratings), "split")
        self.train, self.test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
        self.users = written(ev.eligible_users(self.train, config), "users")
        self.history = self.train.join(F.broadcast(self.users), "user_id", "left_semi")  # at most max_users
        self.relevant = self.test.filter(F.col("rating") >= config.relevant).join(F.broadcast(self.users), "user_id", "left_semi")
        self.quality = written(ev.quality_scores(self.train), "quality")
        self.pool = written(ev.candidate_pool(self.train, config.pool), "pool")
        self.catalogue = self.quality.count()

    def metrics(self, ranked: DataFrame, algorithm: str) -> dict:
        return {"algorithm": algorithm, **ev.ranking_metrics(ranked, self.relevant, self.config.k, self.catalogue).first().asDict()}

    @cached_property
    def shared(self) -> DataFrame:
        """(user_id, item_id, score) of neighbours, for the pool."""
        near = cf.user_neighbors(self.train, self.users).select(F.col("user_id").alias("session_id"), F.col("neighbor_id").alias("user_id"), "similarity")
        session = self.history.select(F.col("user_id").alias("session_id"), "item_id", "rating")
        found = cf.score_candidates(near, self.train, session, cf.EVALUATOR).withColumnRenamed("session_id", "user_id")
        return written(found.join(F.broadcast(self.pool), "item_id", "left_semi"), "shared")

    def by_model(self, model: factors.Model) -> dict:
        found = self.metrics(model.recommend(self.users, self.pool, self.history, self.config.k), "als_biased")
        return found | ev.rmse(model.predict(self.test.join(F.broadcast(self.users), "user_id", "left_semi"))).first().asDict()

    def hybrid_parts(self, model: factors.Model) -> DataFrame:
        """(user_id, item_id, mf, cf, quality) of every user and pool item without history; users and pool are bounded by the settings."""
        pairs = self.users.crossJoin(F.broadcast(self.pool)).join(self.history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        user = Window.partitionBy("user_id")
        rows = model.predict(pairs).join(self.shared.select("user_id", "item_id", "score"), ["user_id", "item_id"], "left").join(self.quality, "item_id", "left")
        scaled = F.when(F.col("score").isNull(), 0.0).otherwise(min_max(F.col("score"), user))
        rows = rows.select("user_id", "item_id", ((F.col("prediction") - 1) / 4).alias("mf"), scaled.alias("cf"), F.coalesce("quality", F.lit(0.0)).alias("quality"))
        return written(rows, "hybrid-parts")

    def by_weights(self, parts: DataFrame, mf: float, cf_: float, quality: float) -> dict:
        found = tuning.evaluate_weights(parts, self.relevant, {"mf": mf, "cf": cf_, "quality": quality}, self.config.k, self.catalogue)
        return {"algorithm": "hybrid", "mf": mf, "cf": cf_, "quality": quality} | found


def compare(data: Dataset, config: ev.Config, model_config: factors.Config | None = None) -> list[dict]:
    """Metrics of the popular, bias, factor, neighbour and hybrid recommenders on the evaluation users."""
    s = Split(data, config)
    model = factors.fit(s.train, model_config)
    best = top(s.shared, "user_id", [F.desc("score"), F.asc("item_id")], config.k)
    return [
        s.metrics(ev.rank_static(s.quality, "quality", s.users, s.history, config.k), "popular"),
        s.metrics(ev.rank_static(ev.bias_scores(s.train), "bias", s.users, s.history, config.k), "bias"),
        s.by_model(model), s.metrics(best, "user_user"),
        s.by_weights(s.hybrid_parts(model), rerank.HYBRID["mf"], rerank.HYBRID["cf"], rerank.HYBRID["quality"]),
    ]


def hybrid_weights() -> list[tuple[float, float, float]]:
    """The two weight grids without repeats; quality of the second is at least a half."""
    more = [(m, c, round(1 - m - c, 4)) for m in MORE_MF for c in MORE_CF if round(1 - m - c, 4) >= 0.5]
    return list(dict.fromkeys(WEIGHTS + more))


def large_search(data: Dataset, folder: str, plan: SearchPlan = SearchPlan(), mf_grid: list[dict] | None = None, weights: list[tuple] | None = None) -> DataFrame:
    """Scale comparison, factor grid and weight grid, each trial once: a run that is repeated skips the trials its logs have.

    Logs are Parquet tables in the folder; the best row of each stage is written to best_summary and returned.
    """
    spark = data.items.sparkSession
    stage = lambda name, users: {"search_stage": name, "max_users": users}
    config = lambda users: replace(ev.Config(), max_users=users, pool=plan.pool)
    logs = {}
    trials = [{"trial_id": f"scale_users_{n}", **stage("scale_comparison", n)} for n in plan.scale]
    logs["scale_comparison"] = tuning.run_trials(spark, trials, lambda t: compare(data, config(t["max_users"])), f"{folder}/scale_comparison")
    split: dict[int, Split] = {}
    on = lambda users: split.setdefault(users, Split(data, config(users)))
    trials = [{"trial_id": f"mf_{g['factors']}_{g['iterations']}_{g['reg']}_{plan.mf}", **stage("mf_search", plan.mf), **g} for g in (MF_GRID if mf_grid is None else mf_grid)]
    fitted = lambda t: factors.fit(on(plan.mf).train, factors.Config(t["factors"], t["iterations"], t["reg"]))
    logs["mf_search"] = tuning.run_trials(spark, trials, lambda t: on(plan.mf).by_model(fitted(t)), f"{folder}/mf_search")
    parts: list[DataFrame] = []

    def weighed(t: dict) -> dict:
        if not parts:
            parts.append(on(plan.hybrid).hybrid_parts(factors.fit(on(plan.hybrid).train)))
        return on(plan.hybrid).by_weights(parts[0], *t["weights"])

    trials = [{"trial_id": f"hybrid_{w[0]}_{w[1]}_{w[2]}_{plan.hybrid}", **stage("hybrid_search", plan.hybrid), "weights": list(w)} for w in (hybrid_weights() if weights is None else weights)]
    logs["hybrid_search"] = tuning.run_trials(spark, trials, weighed, f"{folder}/hybrid_search")
    best = None
    for name, log in logs.items():
        row = ev.best_row(log, ["precision_at_k", "hit_rate_at_k", "map_at_k"]).withColumn("source", F.lit(name))
        best = row if best is None else best.unionByName(row, allowMissingColumns=True)
    files.publish(best, f"{folder}/best_summary")
    return spark.read.parquet(f"{folder}/best_summary")


def objective(data: Dataset, mode: str, config: ev.Config, least_recall: float = 0.55) -> Callable[[dict], dict]:
    """Evaluates a trial's settings for one of the search modes: metrics with `objective`, which is to be greatest."""
    if mode == "recall":
        rows = written(ev.three_way_split(last_ratings(data), config.ranker_ratio, config.test_ratio, config.min_ratings), "split")
        train = rows.filter("split = 'train'")
        users, quality = written(ev.eligible_users(train, config), "users"), written(ev.quality_scores(train), "quality")
        relevant = written(rows.filter(f"split = 'ranker' and rating >= {config.relevant}").join(F.broadcast(users), "user_id", "left_semi").select("item_id").distinct(), "relevant")
        found, wanted = candidates.recalled(train, data.items, users, quality, config.pool, config.k), relevant.count()

        def recall_trial(t: dict) -> dict:
            pool, by = recall.build_pool(found.routes, relevant, quality, config.pool, t["rrf_k"], priors=recall_priors(t))
            size, hits = pool.count(), pool.join(relevant, "item_id", "left_semi").count()
            m = {"route_precision": round(hits / max(size, 1), 6), "route_recall": round(hits / max(wanted, 1), 6), "route_marginal_recall_sum": by.agg(F.round(F.sum("marginal_recall"), 6)).first()[0] or 0.0, "relevant": wanted}
            return m | {"objective": tuning.recall_objective(m, least_recall, config.pool, wanted), "feasible": m["route_recall"] >= tuning.least_reachable(least_recall, config.pool, wanted)}

        return recall_trial
    if mode not in ("hybrid", "mf"):
        raise ValueError(f"unknown mode: {mode}")
    split = Split(data, config)
    scored = lambda m: m | {"objective": tuning.ranking_objective(m)}
    if mode == "mf":
        return lambda t: scored(split.by_model(factors.fit(split.train, factors.Config(t["factors"], t["iterations"], t["reg"]))))
    parts = split.hybrid_parts(factors.fit(split.train))

    def hybrid_trial(t: dict) -> dict:
        if t["mf"] + t["cf"] >= 0.98:
            return {"objective": -1.0}
        return scored(split.by_weights(parts, t["mf"], t["cf"], 1 - t["mf"] - t["cf"]))

    return hybrid_trial


def recall_priors(params: dict) -> dict[str, recall.Prior]:
    """The routes' priors of a trial of the recall space; routes that it lacks keep theirs."""
    found = dict(recall.PRIORS)
    for s in recall.PRIORS:
        if params.get(f"{s}_floor") is not None:
            floor = float(params[f"{s}_floor"])
            cap = float(params[f"{s}_cap"]) if params.get(f"{s}_cap") is not None else min(floor + float(params[f"{s}_cap_extra"]), 1.5)
            found[s] = recall.Prior(floor, cap, float(params[f"{s}_base_weight"]))
    return found


def bayes_search(data: Dataset, folder: str, mode: str = "hybrid", n: int = 30, config: ev.Config | None = None, least_recall: float = 0.55, seed: int = 42) -> dict:
    """n seeded trials of a mode, resumed from the folder's log; writes and returns the best settings and metrics."""
    spark, config = data.items.sparkSession, config or ev.Config()
    judge: list[Callable] = []

    def evaluate(t: dict) -> dict:  # the split and the models are made only if a trial is left
        judge[:] = judge or [objective(data, mode, config, least_recall)]
        return judge[0](t)

    log = tuning.run_trials(spark, tuning.trials(mode, n, seed), evaluate, f"{folder}/{mode}_trials")
    best = ev.best_row(log, ["objective"]).first().asDict()
    found = {"config": {"mode": mode, "trials": n, "seed": seed, "min_route_recall": least_recall, **asdict(config)}, "best_params": {k: best[k] for k in tuning.SPACES[mode]}, "best_metrics": best}
    files.write_text(spark, f"{folder}/best_params.json", json.dumps(found, sort_keys=True, default=str))
    return found


def load_recall_settings(spark: SparkSession, path: str) -> dict:
    """What learn() takes of a recall search: rrf_k and the priors of the routes that it has."""
    found = json.loads("".join(r.value for r in spark.read.text(path).collect()))  # one small file
    params = found.get("best_params", found)
    priors = recall_priors(params)
    return {"rrf_k": float(params["rrf_k"]), "priors": tuple((s, p.floor, p.cap, p.base) for s, p in priors.items() if params.get(f"{s}_floor") is not None)}


def learn(data: Dataset, folder: str | None = None, config: ev.Config | None = None, learning: Learning = Learning()) -> list[dict]:
    """Trains rerankers on the middle ratings, tunes their blends there, and reports all recommenders' metrics on the last ones.

    The pool is what the six routes bring; all 25 features come from models fitted on the earliest ratings. With a folder, the
    metrics, tables of the tuning, route diagnostics, factor model, linear weights and a summary are written there.
    """
    config = config or ev.Config()
    rows = written(ev.three_way_split(last_ratings(data), config.ranker_ratio, config.test_ratio, config.min_ratings), "split")
    train = rows.filter("split = 'train'")
    users, quality = written(ev.eligible_users(train, config), "users"), written(ev.quality_scores(train), "quality")
    own = lambda part: rows.filter(f"split = '{part}'").join(F.broadcast(users), "user_id", "left_semi")  # noqa: E731  at most max_users
    liked = lambda part: own(part).filter(F.col("rating") >= config.relevant).select("user_id", "item_id")
    middle, relevant, catalogue = liked("ranker"), liked("test"), quality.count()
    found = candidates.recalled(train, data.items, users, quality, config.pool, config.k, learning.factors)
    pool, diagnostics = recall.build_pool(found.routes, middle.select("item_id").distinct(), quality, config.pool, learning.rrf_k, priors=learning.own_priors())
    pool = written(pool.select("item_id").union(middle.select("item_id")).distinct(), "pool")  # what is trained on may be asked of the routes' pool
    history = train.select("user_id", "item_id")
    pairs = users.crossJoin(F.broadcast(pool)).join(history, ["user_id", "item_id"], "left_anti")  # both bounded by the settings
    pairs = pairs.join(rows.filter("split <> 'train'").select("user_id", "item_id", "split", "rating"), ["user_id", "item_id"], "left")
    pairs = written(pairs.withColumn("label", F.when((F.col("split") == "ranker") & (F.col("rating") >= config.relevant), 1).otherwise(0)), "pairs")
    matrix = rerank.feature_matrix(pairs, train, data.items, quality, found.extras(pairs, train))
    matrix = written(matrix.withColumn("hybrid", rerank.weighted(rerank.HYBRID)), "features")
    fitting = matrix.filter("split is null or split = 'ranker'")  # test rows are never trained on
    sampled = rerank.sample_negatives(fitting, learning.per_positive, learning.negatives)
    sampled = written(sampled, "sampled")
    later = matrix.filter("split is null or split = 'test'")
    user = Window.partitionBy("user_id")
    scaled = lambda name: min_max(F.col(name), user)
    metrics: list[dict] = []

    def measured(scored: DataFrame, score, algorithm: str) -> None:
        order = user.orderBy(F.desc(F.round(score, 8)), "item_id")
        ranked = scored.withColumn("rank", F.row_number().over(order))
        metrics.append({"algorithm": algorithm, **ev.ranking_metrics(ranked, relevant, config.k, catalogue).first().asDict()})

    for name, column in (("popular", "quality"), ("user_user", "cf"), ("als_biased", "mf"), ("hybrid", "hybrid")):
        measured(later, F.col(column), name)
    if learning.neural:
        network = rerank.fit_neural(sampled, model=found.model)
        measured(network.score(later), F.col("ranker_score"), "neural")
    linear = rerank.fit_pointwise(sampled)
    own_order = linear.score(fitting).select("user_id", "item_id", "hybrid", "ranker_score")
    if learning.blend == "value":
        tuned = own_order.select("user_id", "item_id", scaled("ranker_score").alias("learned"), scaled("hybrid").alias("base"))
    else:
        place = lambda c: rerank.blend(F.col(c), F.col(c), 1.0, mode="rank")
        tuned = own_order.select("user_id", "item_id", place("ranker_score").alias("learned"), place("hybrid").alias("base"))
    weight, blends = tuning.tune_blend(written(tuned, "blends"), middle, config.k, gain=learning.least_gain)
    stacked = written(linear.score(later).withColumn("stacked", rerank.blend(F.col("ranker_score"), F.col("hybrid"), weight, mode=learning.blend)), "stacked")
    measured(stacked, F.col("stacked"), "stacked_linear")
    alpha, residuals = 0.0, None
    if learning.pairwise:
        measured(rerank.fit_pairwise(sampled).score(later), F.col("ranker_score"), "pairwise_linear")
    if learning.residual:
        base = lambda df: linear.score(df).withColumnRenamed("ranker_score", "base")
        corrector = rerank.fit_residual(base(sampled), F.col("base"))
        gaps = corrector.score(base(fitting)).select("user_id", "item_id", "base", F.col("ranker_score").alias("residual"))
        alpha, residuals = tuning.tune_residual(written(gaps, "gaps"), middle, config.k)
        measured(corrector.score(base(later)), rerank.add_residual(F.col("base"), F.col("ranker_score"), alpha), "residual_linear")
    if learning.mmr:
        near = stacked.select("user_id", "item_id", F.col("stacked").alias("relevance")).join(found.model.items.select("item_id", F.col("q").alias("vector")), "item_id")
        measured(selection.mmr(near, config.k), -F.col("position"), "mmr_stacked")
    if folder:
        spark, labels = data.items.sparkSession, sampled.groupBy("label").count().collect()
        rows_of = lambda table: spark.createDataFrame(table)
        files.write_rows_csv([rows_of([m]) for m in metrics], f"{folder}/metrics")
        files.write_rows_csv([blends], f"{folder}/blend_tuning")
        if residuals is not None:
            files.write_rows_csv([residuals], f"{folder}/residual_tuning")
        files.write_rows_csv([diagnostics], f"{folder}/candidate_recall")
        found.model.save(f"{folder}/model")
        points = sorted({1, max(1, learning.factors.iterations // 2), learning.factors.iterations})
        files.write_rows_csv([rows_of(factors.training_history(train, learning.factors, points))], f"{folder}/mf_training")
        best = max(metrics, key=lambda m: (m["precision_at_k"], m["hit_rate_at_k"], m["map_at_k"]))
        priors = [[s, p.floor, p.cap, p.base] for s, p in learning.own_priors().items()]
        settings = {**asdict(config), "candidate_limit": config.pool, "candidate_recall_rrf_k": learning.rrf_k, "candidate_recall_priors": priors, "negative_sampling": learning.negatives}
        summary = {"config": settings, "linear_blend_weight": weight, "linear_blend_mode": learning.blend, "residual_alpha": alpha, "examples": {str(r.label): r["count"] for r in labels}, "best_metric": best}
        files.write_artifact(linear.standard_weights(), summary, folder, spark)
    return metrics
