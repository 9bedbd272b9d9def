"""Mining of tag aliases: candidate pairs by shared tokens and co-occurrence, confidence, bands, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import compact, gestalt, singular_tokens, tag_key, token_similarity
from .vectors import tag_cooccurrence

# Words that make a pair noise.
RATING_TOKENS = ["g", "pg", "pg13", "r", "nc17"]
SHORT_FILLERS = ["ass", "s"]
LONG_FILLERS = ["good", "great", "multiple", "some", "strong", "sustained", "stylized", "bloody"]
FILLERS = [SHORT_FILLERS, LONG_FILLERS]
# Keys of one signature, and of one token, above which they are no evidence.
MOST_OF_SIGNATURE, MOST_OF_TOKEN = 60, 120


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """decisions(source, target, decision, ts) -> the last one of each pair."""
    keyed = decisions.withColumns({"source": tag_key(F.col("source")), "target": tag_key(F.col("target"))}).filter("source <> '' and target <> '' and source <> target")
    w = Window.partitionBy("source", "target").orderBy(F.desc("ts"), F.desc("decision"))
    return keyed.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """Pairs a < b of keys(tag) with one compact signature or a common token.

    Larger buckets than MOST_OF_SIGNATURE or MOST_OF_TOKEN are no evidence, as in the feature's definition, and give none.
    """
    marks = F.array_union(F.array(F.concat(F.lit("="), compact(F.col("tag")))), singular_tokens(F.col("tag")))
    blocks = keys.select("tag", F.explode(marks).alias("block")).distinct()
    most = F.when(F.col("block").startswith("="), MOST_OF_SIGNATURE).otherwise(MOST_OF_TOKEN)
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(F.lit(2), most))
    kept = blocks.join(sizes.select("block"), "block")
    return kept.alias("x").join(kept.alias("y"), "block").filter("x.tag < y.tag").select(F.col("x.tag").alias("a"), F.col("y.tag").alias("b")).distinct()


def alias_report(tags: DataFrame, decisions: DataFrame | None = None, least_confidence: float = 0.68, limit: int = 200) -> DataFrame:
    """tags(item_id, tag) -> likely aliases, the surest first: source (rarer) -> target (commoner), confidence, band, overlap, support."""
    named = tags.select("item_id", tag_key(F.col("tag")).alias("tag")).filter("tag <> ''")
    counts = named.groupBy("tag").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("item_id").alias("items"))
    co = tag_cooccurrence(named)
    pairs = candidate_pairs(counts).unionByName(co.select("a", "b")).distinct().join(co, ["a", "b"], "left").fillna({"overlap": 0})
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("tag").alias(side), F.col("count").alias(f"count_{side}"), F.col("items").alias(f"items_{side}")), side)
    x, y = F.array_distinct(singular_tokens(F.col("a"))), F.array_distinct(singular_tokens(F.col("b")))
    only = lambda p, q: F.array_except(p, q)
    filler = lambda p, q: (F.size(only(q, p)) == 0) & (F.size(only(p, q)) > 0) & F.greatest(*[(F.size(F.array_except(only(p, q), F.array(*map(F.lit, f)))) == 0) for f in FILLERS])
    rated = F.arrays_overlap(F.concat(x, y), F.array(*map(F.lit, RATING_TOKENS)))
    pairs = pairs.filter(~(rated | filler(x, y) | filler(y, x)))
    jac = F.col("overlap") / (F.col("items_a") + F.col("items_b") - F.col("overlap"))
    inside = F.col("overlap") / F.least("items_a", "items_b")
    pairs = pairs.withColumns({"text": F.greatest(gestalt("a", "b"), gestalt(compact(F.col("a")), compact(F.col("b")))), "token": token_similarity(x, y), "jaccard": jac, "containment": inside, "support": F.least("count_a", "count_b")})
    signal = (F.greatest("text", "token") >= 0.82) | ((F.col("overlap") >= 2) & ((F.col("jaccard") >= 0.55) | (F.col("containment") >= 0.8)))
    confidence = F.least(F.lit(0.98), 0.58 * F.greatest("text", 0.96 * F.col("token")) + 0.32 * F.greatest("jaccard", 0.82 * F.col("containment"))
                         + 0.08 * F.least(F.log1p(F.col("support").cast("double")) / F.log1p(F.lit(12.0)), F.lit(1.0)) + 0.05 * F.least(F.col("overlap") / 8, F.lit(1.0)))
    kept = pairs.filter(signal).withColumn("confidence", F.round(confidence, 4)).filter(F.col("confidence") >= least_confidence)
    first = (F.col("count_a") < F.col("count_b")) | ((F.col("count_a") == F.col("count_b")) & ((F.length("a") > F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))))
    band = F.when((F.col("confidence") >= 0.86) & ((F.col("support") >= 2) | (F.col("overlap") >= 2)), "high").when(F.col("confidence") >= 0.74, "medium").otherwise("low")
    out = kept.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"), "confidence", band.alias("band"), "overlap", "support", F.greatest("count_a", "count_b").alias("most"))
    if decisions is not None:
        out = out.join(latest_decisions(decisions).select("source", "target"), ["source", "target"], "left_anti")
    return out.orderBy(F.desc("confidence"), F.desc("overlap"), F.desc("most"), "target", "source").limit(limit)
