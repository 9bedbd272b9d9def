"""Recommendation end to end: similar items, known users, sessions and the online reranker."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import clip, log_share, min_max, top, year_affinity
from ..functions.text import canonical_title, gestalt, same_series
from . import collaborative as cf, recall, rerank, sessions
from .factors import best_items

#: The online routes' tuned shares and weights, and how many items a route may bring.
ONLINE_PRIORS = recall.PRIORS
ROUTE_LIMIT = 800


def series_candidates(target: DataFrame, scores: DataFrame) -> DataFrame:
    """target(item_id, title), one row -> items of its series: 180, less 45 if supplemental, 10 of similarity, a tenth of the score."""
    one = target.select(F.col("item_id").alias("t_id"), F.col("title").alias("t_title")).limit(1)
    both = scores.crossJoin(F.broadcast(one)).filter("item_id <> t_id").withColumn("series", same_series(F.col("t_title"), F.col("title"))).filter("series.is_match")
    value = 180 - F.when(F.col("series.supplemental"), 45).otherwise(0) + 10 * gestalt(canonical_title(F.col("t_title")), canonical_title(F.col("title"))) + 0.1 * F.col("comprehensive_score")
    return both.select("item_id", value.alias("series_score"))


def similar_items_large(target: DataFrame, scores: DataFrame, ratings: DataFrame, n: int = 10) -> DataFrame:
    """Series items first, then items that raters of the target like; a series item's score adds a quarter of its collaborative one."""
    seed = target.select(F.lit(0).alias("session_id"), "item_id", F.lit(5.0).alias("rating"))
    near = cf.profile_neighbors(seed, ratings, cf.LARGE_SESSION, least_shared=1)
    shared = cf.score_candidates(near, ratings, seed, cf.LARGE_SESSION).select("item_id", F.col("score").alias("cf_score"))
    both = series_candidates(target, scores).join(shared, "item_id", "full_outer")
    total = F.coalesce("series_score", F.lit(0.0)) + F.when(F.col("series_score").isNull(), F.col("cf_score")).otherwise(0.25 * F.coalesce("cf_score", F.lit(0.0)))
    rows = both.withColumns({"is_series": F.col("series_score").isNotNull(), "score": F.round(total, 4)}).join(scores.select("item_id", "title"), "item_id")
    return rows.select("item_id", "title", "is_series", "score").orderBy(F.desc("is_series"), F.desc("score"), "item_id").limit(n)


def recommend_user(ratings: DataFrame, user_id: int, n: int = 10, most_history: int = 120) -> DataFrame:
    """For a known user, from its newest ratings."""
    own = ratings.filter(F.col("user_id") == user_id).orderBy(F.desc("ts"), "item_id").limit(most_history)
    others = ratings.filter(F.col("user_id") != user_id)
    return cf.recommend_sessions(own.select(F.col("user_id").alias("session_id"), "item_id", "rating"), others, cf.LARGE_SESSION, n)


def _rated(scores: DataFrame) -> DataFrame:
    """scores with quality: the comprehensive score as a share of the greatest."""
    best = scores.agg(F.max("comprehensive_score").alias("best"))
    return scores.crossJoin(F.broadcast(best)).withColumn("quality", F.when(F.col("best") > 0, clip(F.col("comprehensive_score") / F.col("best"), 0.0, 1.0)).otherwise(0.0)).drop("best")


def profile_score(v, b, q, c):
    """0.45 of nearness to the liked items' mean year, 0.20 to their mean rating and 0.35 of quality."""
    years = np.where((v[:, 1:2] > 0) & (q[:, 1] > 0), np.exp(-np.abs(q[:, 0] - v[:, 0:1]) / 18), 0.0)
    means = np.where(v[:, 3:4] > 0, np.exp(-np.abs(q[:, 2] - v[:, 2:3]) / 0.8), 1.0)
    return 0.45 * years + 0.2 * means + 0.35 * q[:, 3]


def year_score(v, b, q, c):
    """0.7 of nearness to the liked items' mean year and 0.3 of quality; sessions without such a year have none."""
    years = np.where(q[:, 1] > 0, np.exp(-np.abs(q[:, 0] - v[:, 0:1]) / 18), 0.0)
    return np.where(v[:, 1:2] > 0, 0.7 * years + 0.3 * q[:, 3], -np.inf)


def model_score(v, b, q, c):
    """0.75 of what the factors say of the liked items' mean vector and 0.25 of quality, the vector's last number."""
    return 0.75 * (v @ q[:, :-1].T + c) + 0.25 * q[:, -1]


def online_routes(profile: DataFrame, scores: DataFrame, ratings: DataFrame, model=None, limit: int = 600) -> DataFrame:
    """(session_id, source, item_id, score): the candidates that each of six routes gives each session.

    Every item is scored for the year and profile routes, and ROUTE_LIMIT are kept. With a factor model mf_user_top is its view
    of the liked items, else 0.45 of the profile route and 0.55 of quality, or the popular items where there is no such route.
    """
    seen = profile.select(F.col("session_id").alias("user_id"), "item_id").distinct()
    rated = _rated(scores).select("item_id", "release_year", "bayesian_rating", "avg_rating", "quality")
    popular = rated.orderBy(F.desc("quality"), "item_id").limit(max(limit // 3, 50)).select("item_id", "quality")
    liked = profile.filter("rating >= 3.6")
    tastes = profile.select("session_id").distinct().join(
        liked.join(rated, "item_id", "left").groupBy("session_id").agg(F.avg("release_year").alias("year"), F.avg(F.coalesce("avg_rating", F.lit(0.0))).alias("mean")), "session_id", "left"
    )
    known = lambda c: F.col(c).isNotNull().cast("double")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    users = tastes.select(F.col("session_id").alias("user_id"), F.array(number("year"), known("year"), number("mean"), known("mean")).alias("v"), F.lit(0.0).alias("bias"))
    pool = rated.select("item_id", F.array(number("release_year"), known("release_year"), number("avg_rating"), number("quality")).alias("q"), F.lit(0.0).alias("bias"))
    named = lambda df, source, value: df.select(F.col("user_id").alias("session_id"), F.lit(source).alias("source"), "item_id", F.col(value).alias("score"))
    near = best_items(users.filter("v[1] > 0 or v[3] > 0"), pool, seen, ROUTE_LIMIT, profile_score, "value").persist()  # two routes read it
    dated = best_items(users.filter("v[1] > 0"), pool, seen, ROUTE_LIMIT, year_score, "value")
    fixed = users.select("user_id").crossJoin(F.broadcast(popular))  # at most limit / 3 items
    parts = [named(fixed, "popular_quality", "quality"), named(near, "profile_centroid", "value"), named(dated, "year_affinity", "value")]
    if model is not None:
        weight = F.greatest(F.col("rating") - 3, F.lit(0.25))
        seeds = liked.join(model.items.filter("q is not null").select("item_id", "q"), "item_id").select(F.col("session_id").alias("user_id"), weight.alias("w"), F.posexplode("q").alias("k", "x"))
        means = seeds.groupBy("user_id", "k").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
        means = means.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("l")).select("user_id", F.col("l.x").alias("v"), F.lit(0.0).alias("bias"))
        factors_ = model.items.filter("q is not null").join(rated.select("item_id", "quality"), "item_id", "left")
        factors_ = factors_.select("item_id", F.concat(F.transform("q", lambda x: x.cast("double")), F.array(number("quality"))).alias("q"), F.col("item_bias").alias("bias"))
        parts.append(named(best_items(means, factors_, seen, max(limit, 100), model_score, "value"), "mf_user_top", "value"))
    else:
        proxy = near.join(rated.select("item_id", "quality"), "item_id").withColumn("value", 0.45 * F.col("value") + 0.55 * F.col("quality"))
        without = users.filter("v[1] = 0 and v[3] = 0").select("user_id").crossJoin(F.broadcast(popular))
        parts += [named(proxy, "mf_user_top", "value"), named(without, "mf_user_top", "quality")]
    parts.append(top(cf.two_hop(profile, ratings), "session_id", [F.desc("score"), F.desc("support"), F.asc("item_id")], limit).select("session_id", F.lit("item_item_cf").alias("source"), "item_id", "score"))
    shared = cf.score_candidates(cf.profile_neighbors(profile, ratings, cf.LARGE_SESSION), ratings, profile, cf.LARGE_SESSION)
    parts.append(top(shared, "session_id", [F.desc("score"), F.desc("support"), F.asc("item_id")], limit).select("session_id", F.lit("user_user_cf").alias("source"), "item_id", "score"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(seen.withColumnRenamed("user_id", "session_id"), ["session_id", "item_id"], "left_anti")


def combine_routes(routes: DataFrame, limit: int, k: float = 20.0, priors: dict[str, recall.Prior] = ONLINE_PRIORS) -> DataFrame:
    """Each session's fused candidates: quota is the cap's share of the limit, weight base * (0.35 + floor)."""
    table = routes.sparkSession.createDataFrame([(s, int(limit * p.cap), p.base * (0.35 + p.floor)) for s, p in priors.items()], "source string, quota int, weight double")
    order = Window.partitionBy("session_id", "source").orderBy(F.desc(F.round("score", 8)), "item_id")
    ranked = routes.withColumn("n", F.row_number().over(order)).join(F.broadcast(table), "source").filter("n <= quota")
    fused = ranked.groupBy("session_id", "item_id").agg(F.sum(F.col("weight") / (max(k, 1.0) + F.col("n"))).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))
    return top(fused, "session_id", [F.desc(F.round("score", 8)), F.desc(F.size("sources")), F.asc("item_id")], limit)


def online_features(fused: DataFrame, routes: DataFrame, profile: DataFrame, scores: DataFrame) -> DataFrame:
    """fused(session_id, item_id, score, sources) with the 25 features as a session knows them.

    The profile route stands for similarity to what is liked, the disliked items' mean year for dissimilarity, mf_user_top for the
    factors; counts are logarithms as a share of the greatest.
    """
    own = Window.partitionBy("session_id", "source")
    scaled = routes.withColumn("v", min_max(F.col("score"), own))
    wide = scaled.groupBy("session_id", "item_id").agg(*[F.max(F.when(F.col("source") == s, F.col("v"))).alias(f"r_{s}") for s in ONLINE_PRIORS])
    rated = _rated(scores).select("item_id", "release_year", "avg_rating", "rating_count", "quality")
    edge = rated.agg(F.max("rating_count").alias("most"), F.min("release_year").alias("low"), F.max("release_year").alias("high"))
    stats = sessions.profile_stats(profile, scores)
    rows = fused.join(wide, ["session_id", "item_id"], "left").join(rated, "item_id").join(stats, "session_id").crossJoin(F.broadcast(edge))
    r = lambda s: F.coalesce(f"r_{s}", F.lit(0.0))
    dislike = year_affinity(F.col("release_year"), F.col("negative_year"))
    made = {
        "mf": F.coalesce("r_mf_user_top", "quality"), "cf": r("user_user_cf"), "quality": F.col("quality"), "item_avg": F.coalesce("avg_rating", F.lit(0.0)) / 5, "item_count": log_share(F.col("rating_count"), F.col("most")),
        "user_avg": F.col("mean") / 5, "user_count": log_share(F.col("n"), F.col("most")), "positive_similarity": r("profile_centroid"), "negative_similarity": dislike,
        "similarity_margin": 0.5 + 0.5 * (r("profile_centroid") - dislike), "item_item": r("item_item_cf"), "user_positives": F.least(F.col("positives") / 20, F.lit(1.0)), "user_positive_rate": F.col("positive_rate"),
        "year": F.coalesce((F.col("release_year") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1)), F.lit(0.0)), "has_year": F.col("release_year").isNotNull().cast("double"),
        "year_affinity": year_affinity(F.col("release_year"), F.col("positive_year")), "route_surfaced": F.lit(1.0), "route_score": F.col("score") / F.max("score").over(Window.partitionBy("session_id")),
        "route_sources": F.size("sources") / len(ONLINE_PRIORS), **{f"route_{s}": r(s) for s in ONLINE_PRIORS},
    }
    return rows.select("session_id", "item_id", "sources", *[clip(made[f], 0.0, 1.0).cast("double").alias(f) for f in rerank.FEATURES])


#: Which bucket an item is shown in, by the first of these routes that brought it; "top" if none did.
BUCKETS = [("user_user_cf", "collaborative"), ("item_item_cf", "item_item"), ("profile_centroid", "profile"), ("mf_user_top", "profile"), ("year_affinity", "year")]


def recommend_online(events: DataFrame, scores: DataFrame, ratings: DataFrame, artifact: DataFrame, n: int = 10, limit: int = 600, model=None, k: float = 20.0, priors: dict[str, recall.Prior] = ONLINE_PRIORS) -> DataFrame:
    """Sessions' events -> n items each, by the stacked reranker: routes, fusion, 25 features, linear score.

    (session_id, item_id, score, quality, sources, bucket, rank). Sessions without an opinion on any item have no row; backfill them.
    """
    profile = sessions.active_profile(sessions.since_reset(events)).persist()  # each route reads it
    routes = online_routes(profile, scores, ratings, model, limit).persist()
    matrix = online_features(combine_routes(routes, limit, k, priors), routes, profile, scores)
    done = rerank.linear_score(matrix, artifact).withColumn("score", F.round("online_score", 6))
    bucket = F.lit("top")
    for source, name in reversed(BUCKETS):
        bucket = F.when(F.array_contains("sources", source), name).otherwise(bucket)
    best = top(done, "session_id", [F.desc("score"), F.desc("quality"), F.asc("item_id")], n)
    return best.select("session_id", "item_id", "score", "quality", "sources", bucket.alias("bucket"), "rank")


def reasons(shown: DataFrame) -> DataFrame:
    """shown(bucket, genres, shared_genres, support, ...) with a sentence that says why an item is there; columns may be missing."""
    have = set(shown.columns)
    genre = F.coalesce(F.try_element_at("shared_genres", F.lit(1)) if "shared_genres" in have else F.lit(None).cast("string"), F.try_element_at("genres", F.lit(1)) if "genres" in have else F.lit(None).cast("string"))
    interest = F.when(genre.isNotNull(), F.format_string("Close to the %s you like", genre)).otherwise(F.lit("Close to what you like"))
    support = F.col("support") if "support" in have else F.lit(None).cast("long")
    shared = F.when(support.isNotNull(), F.format_string("Liked by %d people with your taste", support)).otherwise(F.lit("Liked by people with your taste"))
    explore = F.when(genre.isNotNull(), F.format_string("Something new: %s", genre)).otherwise(F.lit("Something new"))
    return shown.withColumn("reason", F.when(F.col("bucket") == "interest", interest).when(F.col("bucket") == "collaborative", shared).otherwise(explore))
