import pytest
from pyspark.sql import functions as F

from starling.functions.text import BLOCKED
from starling.operators import scoring as S

ITEMS = "item_id long, title string, genres array<string>, release_year int"
RATINGS = "user_id long, item_id long, rating double, ts timestamp"


def leniency(spark):
    """A lenient user likes all, a strict one little; each rates one shared and one own item."""
    items = spark.createDataFrame([(1, "Lenient", ["a"], 2000), (2, "Strict", ["a"], 2000)], ITEMS)
    rows = [(10, 1, 4.0, "2020-01-01"), (10, 3, 5.0, "2020-01-01"), (20, 2, 4.0, "2020-01-01"), (20, 4, 1.0, "2020-01-01")]
    return items, spark.createDataFrame(rows, "user_id long, item_id long, rating double, t string").select("user_id", "item_id", "rating", F.to_timestamp("t").alias("ts"))


def test_strict_users_ratings_count_more(spark):
    items, ratings = leniency(spark)
    got = {r.item_id: r for r in S.item_scores(items, ratings, prior=1.0).collect()}
    assert got[1].bayesian_rating == got[2].bayesian_rating
    assert got[1].preference_adjusted_rating < got[2].preference_adjusted_rating


def test_unrated_items_stay_only_in_profiles(spark):
    items, ratings = leniency(spark)
    items = items.union(spark.createDataFrame([(9, "Unrated", [], None)], ITEMS))
    none = spark.createDataFrame([], "item_id long, tag string")
    got = {r.item_id: r for r in S.item_profiles(items, ratings, none).collect()}
    assert got[9].comprehensive_score == 0 and got[9].tag_details == [] and len(got) == 3
    assert {r.item_id for r in S.item_scores(items, ratings).collect()} == {1, 2}


def test_recent_counts_include_the_edge(spark):
    rows = [(1, 1, 3.0, "2020-07-01"), (2, 1, 3.0, "2020-01-03"), (3, 1, 3.0, "2020-01-02"), (4, 2, 3.0, "2019-01-01")]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double, t string").withColumn("ts", F.to_timestamp("t"))
    assert {r.item_id: r.recent_rating_count for r in S.recent_counts(ratings).collect()} == {1: 2}


def test_leaderboard(spark):
    rows = [(i, float(i % 7), i % 3) for i in range(100)]
    scores = spark.createDataFrame(rows, "item_id long, comprehensive_score double, rating_count long").withColumn("preference_adjusted_comprehensive_score", -F.col("comprehensive_score"))
    whole = [r.item_id for r in S.leaderboard(scores, 100).collect()]
    assert whole == [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))]
    assert [r.item_id for r in S.leaderboard(scores.repartition(7), 12, algorithm="merge").collect()] == whole[:12]
    assert S.leaderboard(scores, -3).count() == 0
    with pytest.raises(ValueError):
        S.leaderboard(scores, 3, "best")
    with pytest.raises(ValueError):
        S.item_scores(scores, scores, prior=0)


def test_tags_nest_by_weight(spark):
    tags = spark.createDataFrame([(1, "Funny"), (1, "funny"), (1, "SF"), (1, BLOCKED), (1, " "), (2, "boring day")], "item_id long, tag string")
    got = {r.item_id: r for r in S.nested_tags(S.tag_details(tags)).collect()}
    assert got[1].tags == ["funny", "sci-fi"] and got[1].tag_details[0].aliases == ["funny"] and got[1].tag_count == 3
