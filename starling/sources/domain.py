"""Ratings, items, tags and session events, as read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating, ts, seq): every rating, repeated ones too; seq orders ratings of one time."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.col("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating, ts): the last rating of each user and item. Persisted, as operators read it several times."""
    last = F.max_by(F.struct("rating", "ts"), F.struct("ts", "seq"))
    return raw_ratings(spark, sf_dir).groupBy("user_id", "item_id").agg(last.alias("last")).select("user_id", "item_id", "last.rating", "last.ts").persist()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, genres, release_year)."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("genres"), (1950 + F.col("p_size")).cast("int").alias("release_year"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tag): one row for each word of an item's name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.explode(F.split("p_name", " ")).alias("tag"))


#: What each kind of event means to a session.
EVENT_KINDS = {"purchase": "like", "error": "dislike", "view": "view", "click": "view", "signup": "reset"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, event_type, ts, item_id)."""
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.element_at(kinds, F.col("event_type")).alias("event_type"), "ts",
        F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("item_id"),
    )
