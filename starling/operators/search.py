"""Linear and indexed search over titles, genres and tags, with exact, token, substring and fuzzy stages."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import bigrams, canonical_tag, gestalt, jaccard, normalise, same_series, tokens, canonical_title

# How a match's stage and field rank, and when a fuzzy key counts.
STAGE_RANKS = {"title_phrase": 700, "exact": 620, "token": 560, "substring": 440, "fuzzy_token": 360, "fuzzy": 300}
FIELD_RANKS = {"title": 30, "genre": 20, "tag": 10}
FUZZY_KEY, FUZZY_TOKEN, BEST_MARGIN = 0.72, 0.78, 0.04


def linear_search(items: DataFrame, kind: str, query: str) -> DataFrame:
    """Items whose title, or any of whose genres or tags, contains the query."""
    q = query.strip().lower()
    if kind == "title":
        return items.filter(F.lower("title").contains(q))
    if kind not in ("genre", "tag"):
        raise ValueError(f"unknown kind: {kind}")
    return items.filter(F.exists(f"{kind}s", lambda x: F.lower(x).contains(q)))


def postings(items: DataFrame) -> DataFrame:
    """(field, key, item_id): the phrases of titles, genres and tags. Items without a tags column have none."""
    parts = [items.select(F.lit("title").alias("field"), normalise(F.col("title")).alias("key"), "item_id")]
    for field in ("genre", "tag"):
        if f"{field}s" in items.columns:
            parts.append(items.select(F.lit(field).alias("field"), F.explode(f"{field}s").alias("key"), "item_id").withColumn("key", normalise(F.col("key"))))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.filter("key <> ''").distinct()


def token_postings(phrases: DataFrame) -> DataFrame:
    """(field, token, item_id)."""
    return phrases.select("field", F.explode(tokens(F.col("key"))).alias("token"), "item_id").distinct()


def bigram_index(keys: DataFrame) -> DataFrame:
    """keys(field, key) -> (field, gram, key)."""
    return keys.select("field", "key").distinct().select("field", F.explode(bigrams(F.col("key"))).alias("gram"), "key")


def fuzzy_keys(keys: DataFrame, query: str, least: float = FUZZY_KEY, best_only: bool = False) -> DataFrame:
    """keys(field, key) near a query: (field, key, similarity), the mean of the bigrams' Jaccard and the gestalt ratio.

    Only keys that share a bigram are scored, or all if the query is shorter than three characters. A key stays if the mean or
    the ratio reaches `least`; best_only keeps those within a margin of the field's best.
    """
    q = query.strip().lower()
    keys = keys.select("field", "key").distinct()
    if len(q) >= 3:
        grams = [F.lit(q[i : i + 2]) for i in range(len(q) - 1)]
        keys = keys.filter(F.arrays_overlap(bigrams(F.col("key")), F.array(*grams)))
    # The ratio matches no character twice, so the characters in common bound it; only keys that may reach `least` are walked.
    counts = [F.least(F.lit(n), F.length("key") - F.length(F.replace("key", F.lit(c)))) for c, n in Counter(q).items()]
    most = 2 * sum(counts, F.lit(0)) / (F.length("key") + len(q))
    shared = jaccard(bigrams(F.lit(q)), bigrams(F.col("key")))
    keys = keys.withColumns({"shared": shared, "most": most}).filter((F.col("most") >= least - 1e-9) | ((F.col("shared") + F.col("most")) / 2 >= least - 1e-9))
    scored = keys.withColumn("ratio", gestalt(F.lit(q), F.col("key"))).withColumn("similarity", (F.col("shared") + F.col("ratio")) / 2)
    kept = scored.filter((F.col("similarity") >= least) | (F.col("ratio") >= least)).select("field", "key", F.round("similarity", 6).alias("similarity"))
    if not best_only:
        return kept
    best = F.max("similarity").over(Window.partitionBy("field"))
    return kept.withColumn("best", best).filter(F.col("similarity") >= F.col("best") - BEST_MARGIN).drop("best")


def token_search(phrases: DataFrame, field: str, query: str, fuzzy: bool = True) -> DataFrame:
    """Items that have all query tokens, each exactly or, if no item has it, by its best fuzzy match: (item_id, similarity, stage)."""
    words = sorted(set(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))
    own = token_postings(phrases.filter(F.col("field") == field))
    if not words:
        return own.select("item_id", F.lit(0.0).alias("similarity"), F.lit("token").alias("stage")).limit(0)
    exact = own.filter(F.col("token").isin(words)).select(F.col("token").alias("word"), "item_id", F.lit(1.0).alias("similarity"))
    found = exact
    if fuzzy:
        have = {r.word for r in exact.select("word").distinct().collect()}  # at most the query's words
        for word in [w for w in words if w not in have]:
            near = fuzzy_keys(own.select("field", F.col("token").alias("key")), word, FUZZY_TOKEN)
            near = own.join(near.select(F.col("key").alias("token"), "similarity"), "token")
            found = found.unionByName(near.groupBy("item_id").agg(F.max("similarity").alias("similarity")).withColumn("word", F.lit(word)))
    found = found.groupBy("item_id").agg(F.countDistinct("word").alias("n"), F.avg("similarity").alias("similarity"))
    stage = F.when(F.col("similarity") >= 1.0, "token").otherwise("fuzzy_token")
    return found.filter(F.col("n") == len(words)).select("item_id", "similarity", stage.alias("stage"))


def indexed_search(items: DataFrame, kind: str, query: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """The first stage that finds anything, ranked: (item_id, title, stage, similarity, coverage, score, rank).

    Titles go from the whole phrase to all tokens, a substring and a fuzzy key; genres from the exact key to a fuzzy one; tags,
    after canonicalisation, from exact or substring keys to tokens and a fuzzy key. Large catalogues have titles only.
    """
    if kind not in FIELD_RANKS or (kind != "title" and f"{kind}s" not in items.columns):
        raise ValueError(f"unsupported kind: {kind}")
    q = query.strip().lower()
    phrases = postings(items)
    own = phrases.filter(F.col("field") == kind)
    if kind == "tag":
        q = items.sparkSession.range(1).select(F.coalesce(canonical_tag(F.lit(q), aliases), F.lit(q))).first()[0]
    stages = [own.filter(F.col("key") == q).select("item_id", F.lit(1.0).alias("similarity"), F.lit("title_phrase" if kind == "title" else "exact").alias("stage"))]
    if kind != "title":
        stages[0] = stages[0].unionByName(_substring(own, q)) if kind == "tag" else stages[0]
    if kind != "genre":
        stages.append(token_search(phrases, kind, q))
    if kind == "title":
        stages.append(_substring(own, q))
    near = fuzzy_keys(own.select("field", "key"), q, best_only=True).drop("field")
    stages.append(own.join(near, "key").select("item_id", "similarity", F.lit("fuzzy").alias("stage")))
    order = stages[0].withColumn("step", F.lit(0))
    for k, s in enumerate(stages[1:], 1):
        order = order.unionByName(s.withColumn("step", F.lit(k)))
    first = order.agg(F.min("step").alias("first"))  # one row
    found = order.join(F.broadcast(first), F.col("step") == F.col("first")).drop("first")
    return rank_matches(found.drop("step"), items, kind, q)


def _substring(own: DataFrame, q: str) -> DataFrame:
    hits = own.filter(F.col("key").contains(q) & (F.col("key") != q)) if q else own.limit(0)
    return hits.select("item_id", F.round(gestalt(F.lit(q), F.col("key")), 6).alias("similarity"), F.lit("substring").alias("stage"))


def rank_matches(found: DataFrame, items: DataFrame, kind: str, query: str) -> DataFrame:
    """One row for each item, its best: by stage, field, similarity, how much of the title the query covers, score and id."""
    rank: Column = F.element_at(F.create_map(*[F.lit(x) for p in STAGE_RANKS.items() for x in p]), F.col("stage")) + FIELD_RANKS[kind]
    score = "comprehensive_score" if "comprehensive_score" in items.columns else None
    joined = found.join(items.select("item_id", "title", (F.col(score) if score else F.lit(0.0)).alias("score")), "item_id").withColumn("priority", rank)
    share = F.round(F.least(F.lit(len(query)) / F.greatest(F.length("title"), F.lit(1)), F.lit(1.0)), 6)
    joined = joined.withColumn("coverage", share if kind == "title" else F.lit(1.0))
    keys = [F.desc("priority"), F.desc("similarity"), F.desc("coverage"), F.desc("score"), F.asc("item_id")]
    best = joined.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(*keys))).filter("n = 1").drop("n")
    return best.orderBy(*keys)


def similar_items(items: DataFrame, item_id: int, n: int = 10) -> DataFrame:
    """Items like one: 120 for its series (85 if supplemental), 10 a shared genre, 15 a shared tag, 8 of title similarity, a tenth of the score."""
    target = items.filter(F.col("item_id") == item_id).limit(1)
    target = target.select(F.col("title").alias("t_title"), F.col("genres").alias("t_genres"), F.col("tags").alias("t_tags"))
    both = items.filter(F.col("item_id") != item_id).crossJoin(F.broadcast(target))  # one row
    both = both.withColumns({"series": same_series(F.col("t_title"), F.col("title")), "shared_genres": F.size(F.array_intersect("genres", "t_genres")), "shared_tags": F.size(F.array_intersect("tags", "t_tags"))})
    both = both.filter((F.col("shared_genres") > 0) | (F.col("shared_tags") > 0) | F.col("series.is_match"))
    both = both.withColumn("title_similarity", gestalt(canonical_title(F.col("t_title")), canonical_title(F.col("title"))))
    series = F.when(F.col("series.is_match"), 120 - F.when(F.col("series.supplemental"), 35).otherwise(0)).otherwise(0)
    score = series + 10 * F.col("shared_genres") + 15 * F.col("shared_tags") + 8 * F.col("title_similarity") + 0.1 * F.col("comprehensive_score")
    return both.select("item_id", "title", F.col("series.is_match").alias("is_series"), "shared_genres", "shared_tags", F.round("title_similarity", 4).alias("title_similarity"), F.round(score, 4).alias("score")).orderBy(F.desc("score"), "item_id").limit(n)
