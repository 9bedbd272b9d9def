"""Content vectors of items, their cosine, tag semantics and co-occurrence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import bounded_share, top
from ..functions.text import facet

# The weights of the parts of a content vector.
NUMERIC_WEIGHTS = {"rating_score": 0.7, "popularity_score": 0.9, "tag_score": 0.55, "freshness_score": 0.4, "comprehensive_score": 0.85}
MOST_TAGS, MOST_IDF = 40, 4.2


def tag_idf(item_tags: DataFrame, n_items: int | None = None) -> DataFrame:
    """item_tags(item_id, tag) -> (tag, df, idf): ln((N + 1) / (df + 1)) + 1, at most 4.2."""
    n = item_tags.agg(F.countDistinct("item_id").alias("n")) if n_items is None else item_tags.sparkSession.range(1).select(F.lit(n_items).alias("n"))
    df = item_tags.groupBy("tag").agg(F.countDistinct("item_id").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("tag", "df", F.least(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, F.lit(MOST_IDF)).alias("idf"))


def content_vectors(profiles: DataFrame) -> DataFrame:
    """profiles of items with genres, tag_details and scores -> (item_id, feature, value), long form.

    genre: 2.6 / sqrt(genres); tag: for the first 40, 1.4 * idf * min(sqrt(w), 2.2) / sqrt(summed w); facet: 0.18 a tag; num: each
    score's share of its maximum, weighted.
    """
    genres = profiles.filter(F.size("genres") > 0).select("item_id", F.explode("genres").alias("g"), (2.6 / F.sqrt(F.size("genres"))).alias("value"))
    genres = genres.select("item_id", F.concat(F.lit("genre:"), F.lower("g")).alias("feature"), "value")
    listed = profiles.select("item_id", F.explode(F.slice("tag_details", 1, MOST_TAGS)).alias("t")).select("item_id", "t.tag", "t.weight")
    listed = listed.withColumn("total", F.sum("weight").over(Window.partitionBy("item_id")))
    idf = tag_idf(profiles.select("item_id", F.explode("tags").alias("tag")))
    weighted = F.col("idf") * 1.4 * F.least(F.sqrt("weight"), F.lit(2.2)) / F.sqrt(F.greatest("total", F.lit(1e-9)))
    tagged = listed.join(idf, "tag").select("item_id", F.concat(F.lit("tag:"), F.col("tag")).alias("feature"), weighted.alias("value"))
    facets = listed.select("item_id", F.concat(F.lit("tag_facet:"), facet(F.col("tag"))).alias("feature"), F.lit(0.18).alias("value"))
    most = profiles.agg(*[F.max(c).alias(f"most_{c}") for c in NUMERIC_WEIGHTS])
    pairs = [F.struct(F.lit(f"num:{c}").alias("feature"), (bounded_share(F.col(c), F.col(f"most_{c}")) * w).alias("value")) for c, w in NUMERIC_WEIGHTS.items()]
    numbers = profiles.crossJoin(F.broadcast(most)).select("item_id", F.explode(F.array(*pairs)).alias("p")).select("item_id", "p.feature", "p.value")
    every = genres.unionByName(tagged).unionByName(facets).unionByName(numbers)
    return every.groupBy("item_id", "feature").agg(F.sum("value").alias("value")).filter("value <> 0")


def unit(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """Vectors of length 1."""
    return vectors.withColumn("norm", F.sqrt(F.sum(F.col("value") ** 2).over(Window.partitionBy(key)))).filter("norm > 0").select(key, "feature", (F.col("value") / F.col("norm")).alias("value"))


def cosine(vectors: DataFrame, query: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """query(feature, value) against the inverted index of vectors: (item_id, cosine), positive ones only."""
    q = unit(query.withColumn("q", F.lit(0)), "q").select("feature", F.col("value").alias("weight"))
    found = unit(vectors).join(q, "feature").groupBy("item_id").agg(F.sum(F.col("value") * F.col("weight")).alias("cosine")).filter("cosine > 0")
    return found.join(exclude.select("item_id").distinct(), "item_id", "left_anti") if exclude is not None else found


def add_vectors(*scaled: tuple[DataFrame, float]) -> DataFrame:
    """Sum of (feature, value) vectors, each times its factor."""
    every = None
    for df, by in scaled:
        part = df.select("feature", (F.col("value") * by).alias("value"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("feature").agg(F.sum("value").alias("value"))


def tag_cooccurrence(item_tags: DataFrame, most_tags: int = 70, least: int = 2) -> DataFrame:
    """Pairs of tags a < b of one item, with how many items share them; an item's `most_tags` commonest tags take part."""
    common = item_tags.select("item_id", "tag").distinct().join(item_tags.select("item_id", "tag").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("items")), "tag")
    listed = top(common, "item_id", [F.desc("items"), F.asc("tag")], most_tags).groupBy("item_id").agg(F.sort_array(F.collect_list("tag")).alias("l"))  # bounded by most_tags
    pairs = listed.select(F.explode(F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x AS a, y AS b))))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= least)


def tag_semantics(item_tags: DataFrame, dims: int = 48, least_items: int = 3, least_cosine: float = 0.24, n: int = 10) -> DataFrame:
    """Neighbours of tags in a latent space, of those with an item in common: (tag, neighbour, similarity, shared, rank).

    item_tags(item_id, tag, weight). Rows are ln(1 + w) * (ln((N + 1) / (df + 1)) + 1), of length 1, decomposed as a distributed matrix
    of items by tags; the driver holds `dims` numbers of each tag.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    spark, schema = item_tags.sparkSession, "tag string, neighbour string, similarity double, shared long, rank int"
    df = item_tags.groupBy("tag").agg(F.countDistinct("item_id").alias("df")).filter(F.col("df") >= least_items)
    names = [r.tag for r in df.select("tag").orderBy("tag").collect()]  # a row a tag, as the decomposition has
    if not names:
        return spark.createDataFrame([], schema)
    numbers = spark.createDataFrame(list(enumerate(names)), "k int, tag string")
    total = item_tags.select("item_id").distinct().count()
    known = item_tags.join(df.join(numbers, "tag"), "tag")
    rows = known.select("item_id", "tag", "k", (F.log1p("weight") * (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1)).alias("value"))
    norms = rows.groupBy("k").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    rows = rows.join(norms, "k").select("item_id", "tag", "k", (F.col("value") / F.col("norm")).alias("value")).groupBy("item_id", "tag", "k").agg(F.sum("value").alias("value")).persist()
    per_item = rows.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("l"))  # an item's tags, a row of the matrix
    width = len(names)
    found = RowMatrix(per_item.select("l").rdd.map(lambda r: Vectors.sparse(width, [(x.k, x.value) for x in r.l])), 0, width).computeSVD(min(dims, width), False, 1e-8)
    e = found.V.toArray() * found.s.toArray()
    e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    places = spark.createDataFrame([(name, row.tolist()) for name, row in zip(names, e)], "tag string, e array<double>")
    one, other = rows.select("item_id", F.col("tag").alias("tag")), rows.select("item_id", F.col("tag").alias("neighbour"))
    shared = one.join(other, "item_id").filter("tag <> neighbour").groupBy("tag", "neighbour").agg(F.countDistinct("item_id").alias("shared"))
    both = shared.join(places, "tag").join(places.select(F.col("tag").alias("neighbour"), F.col("e").alias("f")), "neighbour")
    cosine = F.aggregate(F.zip_with("e", "f", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = both.select("tag", "neighbour", F.round(cosine, 6).alias("cosine"), "shared").filter(F.col("cosine") >= least_cosine)
    near = top(near, "tag", [F.desc("cosine"), F.asc("neighbour")], n)
    return near.select("tag", "neighbour", F.round("cosine", 4).alias("similarity"), "shared", "rank")


def expand_tags(weights: DataFrame, neighbours: DataFrame, by: float = 0.3, most: int = 5) -> DataFrame:
    """weights(tag, weight) with by * similarity of each positive tag's weight added to its first neighbours."""
    near = neighbours.filter(F.col("rank") <= most)
    more = weights.filter("weight > 0").join(near, "tag").select(F.col("neighbour").alias("tag"), (F.col("weight") * by * F.col("similarity")).alias("weight"))
    return weights.select("tag", "weight").unionByName(more).groupBy("tag").agg(F.sum("weight").alias("weight"))


def explain_expansion(weights: DataFrame, neighbours: DataFrame, by: float = 0.3, most: int = 5, n: int = 10) -> DataFrame:
    """The n greatest weights that expand_tags() adds: (source, tag, weight, similarity)."""
    near = neighbours.filter(F.col("rank") <= most)
    rows = weights.filter("weight > 0").join(near, "tag").select(F.col("tag").alias("source"), F.col("neighbour").alias("tag"), F.round(F.col("weight") * by * F.col("similarity"), 3).alias("weight"), "similarity")
    return rows.filter("weight > 0").orderBy(F.desc("weight"), "source", "tag").limit(n)
