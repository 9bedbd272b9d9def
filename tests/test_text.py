from difflib import SequenceMatcher

from pyspark.sql import functions as F

from starling.functions import text as X


def column(spark, values, c):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(c).collect()]


def test_lists_tokens_and_bigrams(spark):
    assert column(spark, ["a| b ||c", "(no genres listed)", "", None], X.split_pipe(F.col("x"))) == [["a", "b", "c"], [], [], []]
    assert column(spark, ["It's 2-Fast!", None, "é"], X.tokens(F.col("x"))) == [["it", "s", "2", "fast"], [], []]
    assert column(spark, ["abab", "a", ""], X.bigrams(F.col("x"))) == [["ab", "ba"], ["a"], []]


def test_tags(spark):
    assert column(spark, ["Sci_Fi", "SF", f"{X.BLOCKED.title()} queue", " ", None, "R&B", "twists"], X.canonical_tag(F.col("x"))) == ["sci-fi", "sci-fi", None, None, None, "r and b", "twist ending"]
    assert column(spark, ["space", "quirky", "pixar", "tom hanks", "seen at home", "unheard of"], X.facet(F.col("x"))) == ["theme", "style", "franchise", "person", "meta", "theme"]
    assert X.alias_table({"a": "b", "b": "c", "c": "a"})["a"] in ("a", "b", "c")
    assert column(spark, ["coming-of-age", "sci-fi", "world war ii", "l.a. noir"], X.tag_display(F.col("x"))) == ["Coming-Of-Age", "Sci-Fi", "World War II", "L.A. Noir"]
    row = spark.range(1).select(X.tag_confidence(F.lit(1)), X.tag_confidence(F.lit(0)), X.tag_confidence(F.lit(9)), X.tag_weight(F.lit(5), F.lit("theme"))).first()
    assert row[1:3] == (0.0, 1.0) and abs(row[0] - 0.7057) < 1e-4 and abs(row[3] - 2.1143) < 1e-3


def test_singular_and_compact(spark):
    assert column(spark, ["movies", "boss", "cats dogs", "is", "stories"], F.array_join(X.singular_tokens(F.col("x")), " ")) == ["movy", "boss", "cat dog", "is", "story"]
    assert column(spark, ["Hit Men", "time-travels"], X.compact(F.col("x"))) == ["hitmen", "timetravel"]


def test_gestalt_is_the_standard_one(spark):
    pairs = [("matrx", "matrix"), ("", ""), ("abc", None), ("wikimedia", "wikimania")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(X.gestalt("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


TITLES = ["Matrix, The (1999)", "The Matrix Reloaded (2003)", "Toy Story 2 (1999)", "Toy Story", "Lord of the Rings: The Two Towers", "Rocky III", "Saw Part 4", "Alien: Resurrection"]


def test_series_keys(spark):
    assert column(spark, TITLES, X.series_key(F.col("x"))) == ["matrix", "matrix", "toy story", "toy story", "lord of the rings", "rocky", "saw", "alien"]


def test_same_series(spark):
    pairs = [("The Matrix", "The Matrix Reloaded", True), ("Toy Story", "Toy Story 2", True), ("Toy Soldiers", "Toy Story", False), ("The Man in the Moon", "The Man on Fire", False), ("Saw", "Saw II", False), ("Rocky", "Rocky Mountain", False), ("Planet Earth", "Planet Earth: Bonus Material", True)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", X.same_series(F.col("a"), F.col("b")).alias("s"), "b").collect()
    assert [(r.b, r.s.is_match) for r in rows] == [(r.b, r.want) for r in rows]
    assert rows[-1].s.supplemental and not rows[0].s.supplemental
