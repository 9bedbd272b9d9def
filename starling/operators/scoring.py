"""Statistics of items and users, composite scores and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import bayesian, clip, log_share
from ..functions.text import canonical_tag, facet, tag_confidence, tag_display, tag_weight

LARGE_PRIOR, SMALL_PRIOR, RECENT_DAYS = 563.0, 25.0, 180


def item_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("rating_count"), F.avg("rating").alias("rating_avg"))


def user_stats(ratings: DataFrame) -> DataFrame:
    """Count, mean and the norm of the ratings around the mean."""
    norm = F.sqrt(F.var_pop("rating") * F.count(F.lit(1)))
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("rating_count"), F.avg("rating").alias("rating_avg"), norm.alias("rating_norm"))


def constants(ratings: DataFrame) -> DataFrame:
    """One row: the mean, least and greatest rating and the last time."""
    return ratings.agg(F.avg("rating").alias("global_avg"), F.min("rating").alias("low"), F.max("rating").alias("high"), F.max("ts").alias("last_ts"))


def preference_adjusted(ratings: DataFrame) -> DataFrame:
    """Mean by item of each rating moved from its user's mean to the overall one, within the scale."""
    means = ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    moved = clip(F.col("rating") - F.col("mean") + F.col("global_avg"), F.col("low"), F.col("high"))
    joined = ratings.select("user_id", "item_id", "rating").join(means, "user_id").crossJoin(F.broadcast(constants(ratings)))
    return joined.groupBy("item_id").agg(F.avg(moved).alias("preference_adjusted_rating"))


def recent_counts(ratings: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """Ratings by item in the days up to the last rating of all."""
    last = ratings.agg(F.max("ts").alias("last_ts"))
    recent = ratings.select("item_id", "ts").crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last_ts") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy("item_id").agg(F.count(F.lit(1)).alias("recent_rating_count"))


def item_aggregates(ratings: DataFrame, days: int = RECENT_DAYS) -> tuple[DataFrame, DataFrame]:
    """Count, mean, preference-adjusted mean and recent count of each item, and the row of constants, from two passes over the ratings.

    The first pass sums by user, and the constants come from its rows; the second sums all item columns at once. Both sums are
    persisted: each reader asks for other columns, so Spark would not see that the passes are the same.
    """
    users = ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"), F.sum("rating").alias("total"), F.count(F.lit(1)).alias("n"), F.min("rating").alias("low"), F.max("rating").alias("high"), F.max("ts").alias("last_ts")).persist()
    once = users.agg((F.sum("total") / F.sum("n")).alias("global_avg"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("last_ts").alias("last_ts"))
    moved = clip(F.col("rating") - F.col("mean") + F.col("global_avg"), F.col("low"), F.col("high"))
    recent = F.col("ts") >= F.col("last_ts") - F.expr(f"INTERVAL {int(days)} DAYS")
    rows = ratings.select("user_id", "item_id", "rating", "ts").join(users.select("user_id", "mean"), "user_id").crossJoin(F.broadcast(once))  # one row
    stats = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("rating_count"), F.avg("rating").alias("rating_avg"), F.avg(moved).alias("preference_adjusted_rating"), F.count_if(recent).alias("recent_rating_count"))
    return stats.persist(), once


def item_scores(items: DataFrame, ratings: DataFrame, prior: float = LARGE_PRIOR, days: int = RECENT_DAYS) -> DataFrame:
    """Rated items with their scores: 70 for the Bayesian mean, 25 for popularity, 5 for freshness; plain and preference-adjusted."""
    if prior <= 0 or days <= 0:
        raise ValueError("prior and days must be positive")
    stats, once = item_aggregates(ratings, days)
    most = stats.agg(F.max("rating_count").alias("most"), F.max("recent_rating_count").alias("most_recent")).crossJoin(once.select("global_avg"))
    base = items.select("item_id", "title", "release_year").join(stats, "item_id").crossJoin(F.broadcast(most))
    plain = bayesian(F.col("rating_count"), F.col("rating_avg"), F.col("global_avg"), prior)
    moved = bayesian(F.col("rating_count"), F.col("preference_adjusted_rating"), F.col("global_avg"), prior)
    popular, fresh = log_share(F.col("rating_count"), F.col("most"), 25.0), log_share(F.col("recent_rating_count"), F.col("most_recent"), 5.0)
    four = lambda c, name: F.round(c, 4).alias(name)
    return base.select(
        "item_id", "title", "release_year", four(F.col("rating_avg"), "avg_rating"), four(plain, "bayesian_rating"),
        four(F.col("preference_adjusted_rating"), "preference_adjusted_rating"), four(moved, "preference_adjusted_bayesian_rating"), four(moved - plain, "preference_adjustment"),
        "rating_count", "recent_rating_count", four(plain * 14, "rating_score"), four(moved * 14, "preference_adjusted_rating_score"), four(popular, "popularity_score"),
        four(fresh, "freshness_score"), four(plain * 14 + popular + fresh, "comprehensive_score"), four(moved * 14 + popular + fresh, "preference_adjusted_comprehensive_score"),
        four(F.col("global_avg"), "global_avg_rating"), F.lit(float(prior)).alias("prior_rating_count"),
    )


SCORE_MODES = {"default": "comprehensive_score", "preference_adjusted": "preference_adjusted_comprehensive_score"}


def leaderboard(scores: DataFrame, n: int, mode: str = "default", algorithm: str = "heap") -> DataFrame:
    """The n best rows by score, then ratings, then the smaller id; both algorithms are one plan that keeps n rows a task."""
    if mode not in SCORE_MODES or algorithm not in ("heap", "merge"):
        raise ValueError(f"unknown mode or algorithm: {mode}, {algorithm}")
    return scores.orderBy(F.desc(SCORE_MODES[mode]), F.desc("rating_count"), "item_id").limit(max(n, 0))


def tag_details(tags: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """tags(item_id, tag) -> a row for each item and canonical tag: count, facet, confidence, weight, display, raw aliases."""
    named = tags.select("item_id", F.lower(F.trim("tag")).alias("raw"), canonical_tag(F.col("tag"), aliases).alias("tag")).filter("tag is not null")
    counts = named.groupBy("item_id", "tag").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("raw")).alias("aliases"))
    kind = facet(F.col("tag"))
    return counts.select("item_id", "tag", tag_display(F.col("tag")).alias("display"), "count", kind.alias("facet"), tag_confidence(F.col("count")).alias("confidence"), tag_weight(F.col("count"), kind).alias("weight"), "aliases")


def nested_tags(details: DataFrame) -> DataFrame:
    """An item's tags as one array of structs, the weightiest first, and the summed weight and count."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "tag", "display", "count", "facet", "confidence", "weight", "aliases")))
    plain = F.transform(F.col("l"), lambda x: x.dropFields("w"))
    return details.groupBy("item_id").agg(ordered.alias("l"), F.sum("weight").alias("tag_evidence"), F.sum("count").alias("tag_count")).select("item_id", plain.alias("tag_details"), F.col("l.tag").alias("tags"), "tag_evidence", "tag_count")


def item_profiles(items: DataFrame, ratings: DataFrame, tags: DataFrame, aliases: dict[str, str] | None = None, prior: float = SMALL_PRIOR) -> DataFrame:
    """All items, unrated ones too, with scores: 70 for the Bayesian mean, 20 popularity, 5 tags, 5 freshness; unrated terms are 0."""
    stats, once = item_aggregates(ratings)
    base = items.join(stats, "item_id", "left")
    base = base.join(nested_tags(tag_details(tags, aliases)), "item_id", "left").fillna(0)
    base = base.withColumns({c: F.coalesce(c, F.array().cast(base.schema[c].dataType)) for c in ("genres", "tags", "tag_details")})
    most = base.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"most_{c}") for c in ("rating_count", "recent_rating_count", "tag_evidence")])
    base = base.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(once.select("global_avg")))
    rated = lambda c: F.when(F.col("rating_count") > 0, bayesian(F.col("rating_count"), F.col(c), F.col("global_avg"), prior)).otherwise(0.0)
    plain, moved = rated("rating_avg"), rated("preference_adjusted_rating")
    popular, tagged, fresh = (log_share(F.col(c), F.col(f"most_{c}"), k) for c, k in (("rating_count", 20.0), ("tag_evidence", 5.0), ("recent_rating_count", 5.0)))
    four = lambda c, name: F.round(c, 4).alias(name)
    return base.select(
        "item_id", "title", "genres", "release_year", "tags", "tag_details", "rating_count", "recent_rating_count", "tag_count", four(F.col("tag_evidence"), "tag_evidence"),
        four(F.col("rating_avg"), "avg_rating"), four(plain, "bayesian_rating"), four(F.col("preference_adjusted_rating"), "preference_adjusted_rating"),
        four(moved, "preference_adjusted_bayesian_rating"), four(moved - plain, "preference_adjustment"), four(plain * 14, "rating_score"),
        four(moved * 14, "preference_adjusted_rating_score"), four(popular, "popularity_score"), four(tagged, "tag_score"), four(fresh, "freshness_score"),
        four(plain * 14 + popular + tagged + fresh, "comprehensive_score"), four(moved * 14 + popular + tagged + fresh, "preference_adjusted_comprehensive_score"),
    )
