"""Datasets behind one contract: catalogue, ratings, tags, scores, and what each supports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import split_pipe
from .operators import scoring
from .sources import domain, files


@dataclass
class Dataset:
    """items(item_id, title, genres, release_year), ratings(user_id, item_id, rating, ts), and tags(item_id, tag) where there are any."""

    name: str
    display_name: str
    items: DataFrame
    ratings: DataFrame
    tags: DataFrame | None = None
    prior: float = scoring.LARGE_PRIOR

    @property
    def has_tags(self) -> bool:
        return self.tags is not None

    @cached_property
    def scores(self) -> DataFrame:
        """Profiles with tags for small catalogues, scores of rated items for large ones; kept, as every request reads them."""
        if self.tags is not None:
            return scoring.item_profiles(self.items, self.ratings, self.tags).persist()
        return scoring.item_scores(self.items, self.ratings, self.prior).persist()


def small(spark: SparkSession, folder: str) -> Dataset:
    """Three CSV files: movies, ratings and tags."""
    movies, ratings, tags = files.read_small(spark, folder)
    year = F.regexp_extract("title", r"\((\d{4})\)\s*$", 1)
    items = movies.select(F.col("movieId").alias("item_id"), "title", split_pipe(F.col("genres")).alias("genres"), F.when(year != "", year.cast("int")).alias("release_year"))
    rated = ratings.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating", F.timestamp_seconds("timestamp").alias("ts"))
    return Dataset("small", "CSV catalogue", items, rated, tags.select(F.col("movieId").alias("item_id"), "tag"), scoring.SMALL_PRIOR)


def large(spark: SparkSession, folder: str, limit: int | None = None) -> Dataset:
    """A title file and one rating file for each item; no genres or tags."""
    items = files.read_titles(spark, f"{folder}/movie_titles.txt")
    paths = sorted(r[0] for r in spark.read.format("binaryFile").load(f"{folder}/training_set/mv_*.txt").select("path").collect()) if limit else f"{folder}/training_set/mv_*.txt"
    ratings = files.read_rating_files(spark, paths, limit)
    return Dataset("large", "Rating files", items, ratings.select("user_id", "item_id", F.col("rating").cast("double").alias("rating"), F.col("rating_date").alias("ts")))


def tables(spark: SparkSession, sf_dir: str) -> Dataset:
    """The driver's tables as a catalogue."""
    return Dataset("tables", "Order tables", domain.items(spark, sf_dir), domain.raw_ratings(spark, sf_dir), domain.tags(spark, sf_dir), scoring.SMALL_PRIOR)


REGISTRY = {"small": small, "large": large, "tables": tables}


def load(spark: SparkSession, name: str, folder: str) -> Dataset:
    if name not in REGISTRY:
        raise ValueError(f"unknown dataset: {name}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](spark, folder)
