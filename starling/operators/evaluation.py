"""Time-ordered splits, ranking metrics and baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import bayesian, min_max


@dataclass(frozen=True)
class Config:
    max_users: int = 160
    min_ratings: int = 12
    test_ratio: float = 0.2
    ranker_ratio: float = 0.2
    relevant: float = 4.0
    k: int = 10
    pool: int = 1200


def rated_users(ratings: DataFrame, min_ratings: int) -> DataFrame:
    """All users with min_ratings ratings or more."""
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_ratings).select("user_id")


def eligible_users(ratings: DataFrame, config: Config) -> DataFrame:
    """The first max_users users by id with min_ratings ratings or more."""
    return rated_users(ratings, config.min_ratings).orderBy("user_id").limit(config.max_users)


def time_split(ratings: DataFrame, test_ratio: float = 0.2, min_ratings: int = 2) -> DataFrame:
    """ratings with split: a user's last max(1, round-half-even(n * ratio)) ratings by time and item are test, at least one is train."""
    own = Window.partitionBy("user_id")
    rows = ratings.withColumns({"rn": F.row_number().over(own.orderBy("ts", "item_id")), "n": F.count(F.lit(1)).over(own)}).filter(F.col("n") >= min_ratings)
    cut = F.greatest(F.col("n") - F.greatest(F.bround(F.col("n") * test_ratio, 0).cast("long"), F.lit(1)), F.lit(1))
    return rows.withColumn("split", F.when(F.col("rn") <= cut, "train").otherwise("test")).drop("rn", "n")


def three_way_split(ratings: DataFrame, ranker_ratio: float = 0.2, test_ratio: float = 0.2, min_ratings: int = 3) -> DataFrame:
    """train, ranker and test by time; users that would have no train row are left out."""
    own = Window.partitionBy("user_id")
    rows = ratings.withColumns({"rn": F.row_number().over(own.orderBy("ts", "item_id")), "n": F.count(F.lit(1)).over(own)}).filter(F.col("n") >= min_ratings)
    part = lambda r: F.greatest(F.bround(F.col("n") * r, 0).cast("long"), F.lit(1))
    rows = rows.withColumns({"a": F.col("n") - part(ranker_ratio) - part(test_ratio), "b": F.col("n") - part(test_ratio)}).filter("a >= 1")
    return rows.withColumn("split", F.when(F.col("rn") <= F.col("a"), "train").when(F.col("rn") <= F.col("b"), "ranker").otherwise("test")).drop("rn", "n", "a", "b")


def fit_validation_split(rows: DataFrame) -> DataFrame:
    """A user's last round-half-even(n / 2) rows validate."""
    own = Window.partitionBy("user_id")
    back = F.row_number().over(own.orderBy(F.desc("ts"), F.desc("item_id")))
    return rows.withColumn("part", F.when(back <= F.bround(F.count(F.lit(1)).over(own) * 0.5, 0), "validation").otherwise("fit"))


def quality_scores(train: DataFrame, prior: float = 25.0) -> DataFrame:
    """(item_id, quality): 0.75 of the Bayesian mean over 5 and 0.25 of the count's logarithm over the greatest."""
    stats = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"))
    most = train.agg(F.avg("rating").alias("mu")).crossJoin(stats.agg(F.max("n").alias("most")))
    quality = 0.75 * bayesian(F.col("n"), F.col("mean"), F.col("mu"), prior) / 5 + 0.25 * F.log1p(F.col("n").cast("double")) / F.log1p(F.col("most").cast("double"))
    return stats.crossJoin(F.broadcast(most)).select("item_id", quality.alias("quality"))


def bias_scores(train: DataFrame) -> DataFrame:
    """(item_id, bias): the item's mean less the overall one, between 0 and 1."""
    stats = train.groupBy("item_id").agg(F.avg("rating").alias("mean"))
    edge = stats.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    share = F.when(F.col("high") <= F.col("low"), 1.0).otherwise((F.col("mean") - F.col("low")) / (F.col("high") - F.col("low")))
    return stats.crossJoin(F.broadcast(edge)).select("item_id", share.alias("bias"))


def candidate_pool(train: DataFrame, limit: int, test: DataFrame | None = None, relevant: float = 4.0) -> DataFrame:
    """The limit most rated items, by count, mean and smaller id. With test, its relevant items are added first, which leaks labels."""
    stats = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"))
    best = stats.orderBy(F.desc("n"), F.desc("mean"), "item_id").limit(limit).select("item_id")
    return best if test is None else best.union(test.filter(F.col("rating") >= relevant).select("item_id")).distinct()


def rank_static(scores: DataFrame, column: str, users: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """The k best items of a fixed order that each user has no history with: (user_id, item_id, rank).

    The k-th item without history stands at place k + m, m being the number of the user's history items whose place less their
    own number is below k. So each user meets only k + m places, by an equi-join.
    """
    seen, own = history.select("user_id", "item_id").distinct(), users.select("user_id").distinct()
    longest = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    first = scores.select("item_id", F.round(column, 8).alias("score")).orderBy(F.desc("score"), "item_id").limit(k + longest)
    placed = first.select("item_id", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).alias("place"))  # no more rows than the longest history and k
    met = seen.join(placed, "item_id").withColumn("j", F.row_number().over(Window.partitionBy("user_id").orderBy("place")))
    more = met.filter(F.col("place") - F.col("j") < k).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("m"))
    places = own.join(more, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(1), F.lit(k) + F.coalesce("m", F.lit(0)))).alias("place"))
    found = places.join(placed, "place").join(seen, ["user_id", "item_id"], "left_anti")
    return found.select("user_id", "item_id", F.row_number().over(Window.partitionBy("user_id").orderBy("place")).alias("rank")).filter(F.col("rank") <= k)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int, catalogue: int) -> DataFrame:
    """ranked(user_id, item_id, rank), relevant(user_id, item_id) -> one row of means over users with a relevant item.

    precision, recall, hit rate and mean average precision at k (over min(relevant, k)), share of the catalogue that is recommended.
    """
    wanted = relevant.select("user_id", "item_id").distinct()
    sizes = wanted.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    kept = ranked.filter(F.col("rank") <= k).join(sizes, "user_id", "left_semi")
    marked = kept.join(wanted.withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left").fillna({"hit": 0})
    running = F.sum("hit").over(Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    by = marked.withColumn("gain", F.col("hit") * running / F.col("rank")).groupBy("user_id").agg(F.sum("hit").alias("hits"), F.sum("gain").alias("gain"))
    each = sizes.join(by, "user_id", "left").fillna({"hits": 0, "gain": 0.0})
    means = each.agg(
        F.count(F.lit(1)).alias("users"), F.avg(F.col("hits") / k).alias("precision_at_k"), F.avg(F.col("hits") / F.col("size")).alias("recall_at_k"),
        F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit_rate_at_k"), F.avg(F.col("gain") / F.least("size", F.lit(k))).alias("map_at_k"),
    )
    covered = kept.agg((F.countDistinct("item_id") / F.lit(max(catalogue, 1))).alias("catalog_coverage"))
    four = [F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "hit_rate_at_k", "map_at_k", "catalog_coverage")]
    return means.crossJoin(covered).select("users", *four)


def rmse(predicted: DataFrame) -> DataFrame:
    """predicted(rating, prediction) -> (n, rmse)."""
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2)), 6).alias("rmse"))


def best_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of greatest keys, compared from left to right."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct(*keys)).alias("r")).select("r.*")


def min_max_by_user(scores: DataFrame) -> DataFrame:
    return scores.withColumn("normal", min_max(F.col("score"), Window.partitionBy("user_id")))


def compare(ranked: dict[str, DataFrame], relevant: DataFrame, k: int, catalogue: int) -> DataFrame:
    """One row of metrics for each named recommender."""
    found = None
    for name, df in ranked.items():
        row = ranking_metrics(df, relevant, k, catalogue).withColumn("algorithm", F.lit(name))
        found = row if found is None else found.unionByName(row, allowMissingColumns=True)
    return found
