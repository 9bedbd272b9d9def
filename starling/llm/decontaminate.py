"""Benchmark decontamination: a positional index of training tokens, searched from the rarest test terms.

DataFrame functions only. The index holds the positions of a set of terms in every document. The lists of a window's rarest terms,
each shifted by the term's offset, are intersected for phrases, and paired where they are near each other for proximity; the
other words are then compared in the few documents that are left.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._common import materialise, outlive, steps, table

#: What parts words, once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A proximity match has this share of a window's distinct words.
SHARE = 0.9
#: Rows of test terms, windows and document hashes up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_HASHES = 500_000


def split_words(text: str) -> Column:
    """Words of a text column in order; the first and the last element may be an empty string."""
    return F.split(F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase), SEPARATORS)


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _words(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, w) of each row; h tells rows with one doc_id but other texts apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), split_words("text").alias("w"))


def test_items(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text, ...) -> distinct (i, item_id, m, w) of items with words: m is the number of words, i tells items apart."""
    words = F.filter(split_words("text"), lambda x: x != "")
    items = benchmark.select("item_id", words.alias("w")).filter(F.size("w") > 0).distinct()
    return items.select(F.xxhash64("item_id", F.xxhash64("w")).alias("i"), "item_id", F.size("w").alias("m"), "w")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How often each term of the items occurs in docs; terms that do not occur are missing."""
    terms = _bounded(materialise(items.select(F.explode("w").alias("term")).distinct(), "terms", _words(items)))
    words = _keyed(docs).select(F.explode_outer("w").alias("term"))  # outer: else Spark splits each text twice to test its size
    return words.join(terms, "term", "left_semi").groupBy("term").count()


def windows(items: DataFrame, counts: DataFrame, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(i, s, n, need, distinct, qs, terms) of every window of the items.

    s is its first position in the item, n its words, `distinct` the number of different ones, need how many of them a proximity
    match has. qs and terms are the rarest of these, first places: as many as a proximity match may lack, and two.
    """
    placed = items.select("i", "m", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - width, F.lit(0)))).alias("s"))
    placed = placed.select("i", "s", F.least("m", F.lit(width)).alias("n"), "w", F.explode(F.sequence("s", F.least(F.col("s") + width, F.col("m")) - 1)).alias("q"))
    first = placed.select("i", "s", "n", "q", F.expr("w[q]").alias("term")).groupBy("i", "s", "n", "term").agg(F.min("q").alias("q"))
    ranked = first.join(counts, "term", "left").groupBy("i", "s", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "q", "term"))).alias("t"))
    ranked = ranked.withColumn("distinct", F.size("t")).withColumn("need", F.ceil(F.col("distinct") * share - 1e-9).cast("int"))
    ranked = ranked.withColumn("t", F.slice("t", F.lit(1), F.least("distinct", F.col("distinct") - F.col("need") + 2)))
    return ranked.select("i", "s", "n", "need", "distinct", F.col("t.q").alias("qs"), F.col("t.term").alias("terms"))


def index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings of terms(term), by default of all words, in docs, and for each row of docs one row with its number of words.

    Rows (doc_id, h, n_words, term, pos). A posting has term and pos; a document's own row has n_words.
    """
    blank = lambda at: F.when(F.element_at("w", at) == "", 1).otherwise(0)
    n_words = F.size("w") - blank(1) - F.when(F.size("w") > 1, blank(-1)).otherwise(0)
    words = _keyed(docs).select("doc_id", "h", n_words.cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
    if terms is None:
        hits = words.withColumn("known", F.lit(True))
    else:
        hits = words.join(_bounded(terms.select("term", F.lit(True).alias("known"))), "term", "left")
    hits = hits.filter("pos = 0 or known")
    return hits.select("doc_id", "h", F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"), F.when(F.col("known") & (F.col("term") != ""), F.col("term")).alias("term"), "pos")


def aligned_windows(postings: DataFrame, wins: DataFrame) -> DataFrame:
    """Where the lists of all a window's rarest terms, less their offsets, meet: (doc_id, h, i, start, n, s).

    start is where the item would begin, s the windows that met there; the other words are not compared yet.
    """
    places = wins.select("i", F.explode(F.arrays_zip("qs", "terms")).alias("p")).select("i", F.col("p.qs").alias("q"), F.col("p.terms").alias("term")).distinct()
    lists = postings.join(_bounded(places), "term").select("doc_id", "h", "i", (F.col("pos") - F.col("q")).alias("start"), "q")
    met = lists.groupBy("doc_id", "h", "i", "start").agg(F.collect_set("q").alias("found"))
    own = wins.groupBy("i").agg(F.first("n").alias("n"), F.min(F.size("qs")).alias("fewest"), F.collect_list(F.struct("s", "qs")).alias("wins"))
    whole = lambda x: (F.size(F.array_except(x["qs"], "found")) == 0) & (x["s"] + F.col("start") >= 0)
    met = met.withColumn("k", F.size("found")).join(_bounded(own.select("i", "n", "fewest")), "i").filter("k >= fewest")  # most places met one term only
    met = met.join(_bounded(own.select("i", "wins")), "i").select("doc_id", "h", "i", "start", "n", F.transform(F.filter("wins", whole), lambda x: x["s"]).alias("s"))
    return met.filter(F.size("s") > 0)


def near_places(postings: DataFrame, wins: DataFrame) -> DataFrame:
    """Where two different ones of an item's rarest terms are less than a window apart, or one is all there is: (doc_id, h, i, n, p, r).

    A proximity match has two of its window's rarest terms, so it holds such a pair of neighbours: p and r are their places.
    """
    terms = wins.select("i", F.explode("terms").alias("term")).distinct()
    alone = wins.groupBy("i").agg(F.first("n").alias("n"), F.min("distinct").alias("fewest"))
    lists = postings.join(_bounded(terms), "term").groupBy("doc_id", "h", "i").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("f"))
    lists = lists.join(_bounded(alone), "i")
    pair = F.expr("transform(sequence(1, size(f) - 1), j -> struct(f[j - 1].pos as p, f[j].pos as r, f[j - 1].term <> f[j].term as other))")
    close = F.filter(F.when(F.size("f") > 1, pair), lambda x: x["other"] & (x["r"] - x["p"] < F.col("n")))
    one = F.transform("f", lambda x: F.struct(x["pos"].alias("p"), x["pos"].alias("r"), F.lit(True).alias("other")))
    places = lists.select("doc_id", "h", "i", "n", F.explode(F.when(F.col("fewest") == 1, one).otherwise(close)).alias("x"))
    return places.select("doc_id", "h", "i", "n", "x.p", "x.r")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, h, at, size, ...) with `words`, the document's words from at on, at most size of them."""
    rest = [c for c in wanted.columns if c not in ("doc_id", "h")]
    by = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*rest)).alias("all")).withColumnsRenamed({"doc_id": "__doc", "h": "__h"})
    by = materialise(by, "wanted")
    hashes = by.select(F.col("__h").alias("h")).distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    if hashes.count() <= BROADCAST_HASHES:  # other texts are not shuffled
        texts = texts.join(F.broadcast(hashes), "h", "left_semi")
    texts = texts.dropDuplicates(["doc_id", "h"])
    both = texts.join(by, texts["doc_id"].eqNullSafe(by["__doc"]) & (texts["h"] == by["__h"]))
    both = both.select("doc_id", "h", "all", F.explode_outer(F.array(split_words("text"))).alias("w"))  # so that each text is split once
    cut = F.transform("all", lambda x: F.struct(*[x[c].alias(c) for c in rest], F.slice("w", x["at"] + 1, x["size"]).alias("words")))
    return both.select("doc_id", "h", F.explode(cut).alias("x")).select("doc_id", "h", "x.*")


def matches(docs: DataFrame, postings: DataFrame, items: DataFrame, wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrase matches (doc_id, h, i, start, end), end exclusive, and proximity matches (doc_id, h, i).

    A phrase match is an occurrence of a window's words in a row. A proximity match is an item with a window of n words, `need` of
    whose distinct words are, in any order, among n words in a row of the document; every phrase match is one.
    """
    met = materialise(aligned_windows(postings, wins), "aligned")
    # Documents may begin with an empty string, which takes a position: slices count it, as the postings do.
    low, high = F.array_min("s"), F.array_max("s")
    phrases = met.filter("n > 1").select("doc_id", "h", "i", F.lit(True).alias("phrase"), (F.col("start") + low).alias("at"), (high - low + F.col("n")).alias("size"), "s", "n")
    near = near_places(postings, wins).filter("n > 1")
    from_ = F.greatest(F.lit(0), F.col("r") - F.col("n") + 1)
    near = near.select("doc_id", "h", "i", F.lit(False).alias("phrase"), from_.alias("at"), (F.col("p") + F.col("n") - from_).alias("size"), F.array().cast("array<int>").alias("s"), "n").distinct()
    got = materialise(_fetch(docs, phrases.union(near)), "fetched")
    both = got.join(_bounded(items.select("i", F.col("w").alias("own"))), "i")
    equal = F.filter("s", lambda s: F.slice("words", s - F.array_min("s") + 1, F.col("n")) == F.slice("own", s + 1, F.col("n")))
    found = both.filter("phrase").select("doc_id", "h", "i", (F.col("at") - F.array_min("s")).alias("start"), "n", F.explode(equal).alias("s"))
    single = met.filter("n = 1").select("doc_id", "h", "i", "start", "n", F.explode("s").alias("s"))
    begin = F.col("start") + F.col("s")
    hits = materialise(found.union(single).select("doc_id", "h", "i", begin.alias("start"), (begin + F.col("n")).alias("end")), "hits")
    exact = hits.select("doc_id", "h", "i").distinct()
    lists = wins.select("i", "s", "need").groupBy("i").agg(F.min("need").alias("least"), F.collect_list(F.struct("s", "need")).alias("wins"))
    rest = both.filter("not phrase").join(_bounded(lists), "i").filter(F.size(F.array_intersect("words", "own")) >= F.col("least"))
    keys = exact.withColumnsRenamed({"doc_id": "__doc", "h": "__h", "i": "__i"})
    rest = rest.join(keys, rest["doc_id"].eqNullSafe(keys["__doc"]) & (rest["h"] == keys["__h"]) & (rest["i"] == keys["__i"]), "left_anti")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("n") + 1, F.lit(1))), lambda at: F.slice("words", at, F.col("n")))
    whole = lambda x: F.exists("spans", lambda span: F.size(F.array_intersect(F.slice("own", x["s"] + 1, F.col("n")), span)) >= x["need"])
    some = rest.withColumn("spans", spans).filter(F.exists("wins", whole)).select("doc_id", "h", "i").distinct()
    return hits, exact.union(some)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> a verdict for each row of docs.

    Columns doc_id, h (the text's hash), n_words, n_hit, n_items, items_sha256, contaminated, n_near. A document word inside any
    occurrence of a window of `width` item words is hit; an item of fewer words is one window, one of none has no window.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. n_near counts the items with a proximity match, those with an occurring
    window among them. Null and empty texts have no words. Item rows with one item_id count once; those without an item_id
    hit words but are neither counted nor listed. Repeated rows of docs have equal verdicts.
    """
    with steps():
        items = materialise(test_items(benchmark), "items", benchmark.count())
        n = _words(items)  # no fewer than there are terms or windows
        counts = materialise(term_counts(docs, items), "term-counts", n)
        wins = materialise(windows(items, _bounded(counts), width, share), "windows", n)
        postings = outlive(index(docs, wins.select(F.explode("terms").alias("term")).distinct()), "postings")
        hits, near = matches(docs, postings.filter("term is not null").drop("n_words"), items, wins)
        before = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), "start")))
        counted = hits.select("doc_id", "h", "start", "end").distinct().withColumn("fresh", fresh).groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"))
        ids = _bounded(items.select("i", "item_id"))
        listed = hits.select("doc_id", "h", "i").distinct().join(ids, "i").groupBy("doc_id", "h").agg(F.collect_set("item_id").alias("items"), F.lit(None).cast("long").alias("n_near"))
        nearby = near.join(ids, "i").groupBy("doc_id", "h").agg(F.lit(None).cast("array<string>").alias("items"), F.countDistinct("item_id").alias("n_near"))
        listed = listed.withColumn("items", F.transform("items", lambda x: x.cast("string"))).withColumn("n_hit", F.lit(None).cast("long"))
        parts = listed.select("doc_id", "h", "n_hit", "items", "n_near").union(nearby.select("doc_id", "h", F.lit(None).cast("long"), "items", "n_near"))
        parts = parts.union(counted.select("doc_id", "h", "n_hit", F.lit(None).cast("array<string>"), F.lit(None).cast("long")))
        one = lambda c: F.max(c).alias(c)  # noqa: E731  each has one row of a document
        parts = parts.groupBy("doc_id", "h").agg(one("n_hit"), one("items"), one("n_near"))
        found = outlive(parts.withColumnsRenamed({"doc_id": "__doc", "h": "__h"}), "verdicts")
    own = postings.filter("n_words is not null").select("doc_id", "h", "n_words")
    every = own.join(found, own["doc_id"].eqNullSafe(found["__doc"]) & (F.col("h") == F.col("__h")), "left")
    listed = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return every.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contamination() does not find contaminated, with all their columns.

    Rows without words, null texts among them, stay, and repeated rows stay repeated; an empty table gives an empty table.
    """
    with steps():
        bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h")).distinct()
        bad = outlive(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["text"]) == bad["__h"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("h")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS gram
  FROM i, unnest(range(greatest(len(w) - 12, 1))) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS gram
  FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) AS u(s)),
found AS (SELECT g.doc_id, g.s, g.n, v.item_id FROM grams g JOIN windows v ON g.gram = v.gram AND g.n = v.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id),
bags AS (
  SELECT *, row_number() OVER () AS bag, CAST(ceil(len(terms) * 0.9 - 1e-9) AS INTEGER) AS need FROM (
    SELECT item_id, least(len(w), 13) AS n, list_distinct(w[s + 1 : s + least(len(w), 13)]) AS terms
    FROM i, unnest(range(greatest(len(w) - 12, 1))) AS u(s) WHERE len(w) > 0)),
bag_terms AS (SELECT bag, n, need, unnest(terms) AS term FROM bags),
doc_terms AS (SELECT DISTINCT doc_id, term FROM d, unnest(w) AS u(term)),
pairs AS (SELECT doc_id, bag FROM doc_terms JOIN bag_terms USING (term) GROUP BY doc_id, bag, need HAVING count(*) >= need),
places AS (SELECT doc_id, p, w[p] AS term FROM d, unnest(range(1, len(w) + 1)) AS u(p) WHERE doc_id IN (SELECT doc_id FROM pairs)),
met AS (SELECT doc_id, bag, p, term, n, need FROM pairs JOIN places USING (doc_id) JOIN bag_terms USING (bag, term)),
spans AS (
  SELECT a.doc_id, a.bag FROM met a JOIN met b ON a.doc_id = b.doc_id AND a.bag = b.bag AND b.p BETWEEN a.p AND a.p + a.n - 1
  GROUP BY a.doc_id, a.bag, a.p, a.need HAVING count(DISTINCT b.term) >= a.need),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM spans JOIN bags USING (bag) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
