"""Readers of rating logs, catalogues, event logs and artifacts, and their sinks."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zlib
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MOVIES = "movieId long, title string, genres string"
RATINGS = "userId long, movieId long, rating double, timestamp long"
TAGS = "userId long, movieId long, tag string, timestamp long"
EVENTS = "session_id string, event_type string, timestamp double, kind string, query string, movie_id long, source string"
DECISION = "source string, target string, decision string, ts double"
DECISIONS = ["accept", "reject", "ignore"]
#: The columns of the profiles' CSV, in order.
PROFILE_COLUMNS = [
    "movieId", "title", "genres", "avg_rating", "bayesian_rating", "preference_adjusted_rating", "preference_adjusted_bayesian_rating", "preference_adjustment", "rating_count", "recent_rating_count",
    "tag_count", "tag_evidence", "rating_score", "preference_adjusted_rating_score", "popularity_score", "tag_score", "freshness_score", "comprehensive_score",
    "preference_adjusted_comprehensive_score", "tags",
]
EVENT_TYPES = ["search", "similar", "view", "like", "dislike", "reset"]


def read_small(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue, ratings and tags from three CSV files with headers, under explicit schemas."""
    csv = lambda name, schema: spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    return csv("movies", MOVIES), csv("ratings", RATINGS), csv("tags", TAGS)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, release_year, title) from `id,year,title` lines in Latin-1; only the first two commas split, NULL or empty is no year.

    A line without three parts fails the read.
    """
    whole = spark.read.schema("value string").options(encoding="ISO-8859-1", sep="\u0001", quote="", escape="")  # the text reader knows UTF-8 only
    lines = whole.csv(path).filter(F.trim("value") != "")
    part = lambda i: F.regexp_extract("value", r"^([^,]*),([^,]*),(.*)$", i)
    checked = lines.withColumn("value", F.when(F.col("value").rlike(r"^[^,]*,[^,]*,"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a title line: "), F.col("value")))))
    year = F.when(F.upper(F.trim(part(2))).isin("NULL", ""), None).otherwise(F.trim(part(2)))
    return checked.select(F.trim(part(1)).cast("int").alias("item_id"), year.cast("int").alias("release_year"), part(3).alias("title"))


def read_rating_files(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """(item_id, user_id, rating, rating_date) from files mv_<id>.txt, whose first line names the item; `limit` takes the first files by name."""
    if limit is not None:
        paths = sorted(paths)[:limit]
    lines = spark.read.text(paths).withColumn("item_id", F.regexp_extract(F.col("_metadata.file_name"), r"mv_(\d+)\.txt$", 1).cast("int"))
    fields = F.split("value", ",")
    return lines.filter(~F.col("value").rlike(r"^\s*(\d+:)?\s*$")).select("item_id", fields[0].cast("int").alias("user_id"), fields[1].cast("short").alias("rating"), F.to_date(fields[2], "yyyy-MM-dd").alias("rating_date"))


def inline_ratings(spark: SparkSession, rows: list[tuple[int, float]]) -> DataFrame:
    """A small relation of item and rating from Python values; only finite numbers, and no booleans."""
    for item, rating in rows:
        if isinstance(item, bool) or isinstance(rating, bool) or rating != rating or rating in (float("inf"), float("-inf")):
            raise ValueError(f"not a number: {item}, {rating}")
    return spark.createDataFrame([(int(i), float(r)) for i, r in rows], "item_id long, rating double")


def history(ratings: DataFrame, user_id: int, most: int = 120) -> DataFrame:
    """A user's newest ratings."""
    return ratings.filter(F.col("user_id") == user_id).orderBy(F.desc("ts"), "item_id").limit(most)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines event log; damaged lines and unknown kinds of event are left out, texts are cut, and a missing time is now."""
    rows = spark.read.schema(EVENTS).option("mode", "PERMISSIVE").json(path).filter(F.col("session_id").isNotNull() & F.col("event_type").isin(EVENT_TYPES))
    return rows.select(F.substring("session_id", 1, 120).alias("session_id"), "event_type", F.coalesce("timestamp", F.unix_timestamp().cast("double")).alias("timestamp"), "kind", F.substring("query", 1, 160).alias("query"), "movie_id", "source")


def append_events(events: DataFrame, path: str) -> None:
    events.select(*[f.name for f in T.StructType.fromDDL(EVENTS)]).write.mode("append").json(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on any file system; readers see it whole or not at all."""
    files, made = _files(spark, path)
    folder, _, name = path.rpartition("/")
    draft = made(f"{folder}/.{name}.{uuid.uuid4().hex}")  # names with a dot are not read as data
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(made(path), False)
    files.rename(draft, made(path))


class EventLog:
    """Session events as JSON lines in a folder, one file an event, dealt to parts by session.

    A session's events since its last reset, the newest `most` of them, are kept in memory for the `sessions` asked for last; what is
    not there is read from the session's part, so events outlive the process and no request scans them all.
    """

    PARTS = 64

    def __init__(self, spark: SparkSession, folder: str, most: int = 1000, sessions: int = 10_000):
        self.spark, self.folder, self.most, self.sessions = spark, folder, most, sessions
        self.known: OrderedDict[str, list[dict]] = OrderedDict()

    def _part(self, session_id: str) -> str:
        return f"{self.folder}/part={zlib.crc32(session_id.encode()) % self.PARTS}"

    def append(self, event: dict) -> list[dict]:
        """Writes an event, its texts cut and a missing time filled in; returns its session's events since the last reset."""
        row = {name: event.get(name) for name in T.StructType.fromDDL(EVENTS).names}
        row |= {"session_id": row["session_id"][:120], "query": row["query"] and row["query"][:160], "timestamp": float(time.time() if row["timestamp"] is None else row["timestamp"])}
        own = self.of(row["session_id"])
        write_text(self.spark, f"{self._part(row['session_id'])}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps(row) + "\n")
        own[:] = [] if row["event_type"] == "reset" else [*own, row][-self.most :]
        return own

    def of(self, session_id: str) -> list[dict]:
        """A session's events since its last reset, in order of arrival."""
        session_id = session_id[:120]
        if session_id not in self.known:
            self.known[session_id] = self._read(session_id)
        self.known.move_to_end(session_id)
        if len(self.known) > self.sessions:
            self.known.popitem(last=False)
        return self.known[session_id]

    def _read(self, session_id: str) -> list[dict]:
        path = self._part(session_id)
        files, made = _files(self.spark, path)
        if not files.exists(made(path)):
            return []
        rows = read_events(self.spark, path).filter(F.col("session_id") == session_id).withColumn("file", F.input_file_name())
        last = rows.agg(F.max(F.when(F.col("event_type") == "reset", F.col("file"))).alias("last"))
        rows = rows.crossJoin(F.broadcast(last)).filter(F.col("last").isNull() | (F.col("file") > F.col("last")))
        found = rows.orderBy(F.desc("file")).limit(self.most).drop("last").collect()  # a session's newest events
        return [{k: v for k, v in r.asDict().items() if k != "file"} for r in reversed(found)]


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Alias decisions (source, target, decision, ts); see operators.aliases.latest_decisions."""
    return spark.read.schema(DECISION).json(path).filter(F.col("decision").isin(DECISIONS))


def write_decision(spark: SparkSession, path: str, source: str, target: str, decision: str) -> None:
    """Appends a decision on an alias pair; of several the last counts."""
    if decision not in DECISIONS:
        raise ValueError(f"unknown decision: {decision}")
    spark.createDataFrame([(source.strip().lower(), target.strip().lower(), decision, time.time())], DECISION).coalesce(1).write.mode("append").json(path)


def table_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns of a Parquet table; none if there is no table."""
    files, made = _files(spark, path)
    return spark.read.parquet(path).columns if files.exists(made(f"{path}/_SUCCESS")) else []


def stored(spark: SparkSession, path: str, columns: list[str], build) -> DataFrame:
    """The stored table's columns; if it is missing, or lacks one of them, build() makes it first."""
    if not set(columns) <= set(table_columns(spark, path)):
        publish(build(), path)
    return spark.read.parquet(path).select(*columns)


def insert_rows(df: DataFrame, path: str, schema: str) -> DataFrame:
    """Appends df, registered as a view, to a Parquet table under an explicit schema, column by column with casts."""
    fields, view = T.StructType.fromDDL(schema).fields, f"rows_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        cast = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
        df.sparkSession.sql(f"SELECT {cast} FROM {view}").write.mode("append").parquet(path)
    finally:
        df.sparkSession.catalog.dropTempView(view)
    return df.sparkSession.read.schema(schema).parquet(path)


def write_statistics(ratings: DataFrame, scores: DataFrame, folder: str) -> None:
    """Statistics of items and users, norms and scores as tables in a folder."""
    from ..operators import scoring

    users = scoring.user_stats(ratings)
    publish(scoring.item_stats(ratings), f"{folder}/item_stats")
    publish(users.drop("rating_norm"), f"{folder}/user_stats")
    publish(users.select("user_id", "rating_norm"), f"{folder}/user_norms")
    publish(scores, f"{folder}/scores")


def signature(df: DataFrame, *more) -> str:
    """SHA-256 of a table's rows in any order, and of what else it is built from: a name for its cache.

    Each row is hashed; the sums of the hashes' halves tell the multiset apart, so nothing is collected or sorted.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    row = df.agg(F.count(F.lit(1)).cast("string").alias("n"), *[half(8 * i + 1).alias(f"h{i}") for i in range(8)]).first()
    return hashlib.sha256(json.dumps([list(row), *more], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The table that `build` makes, from the folder if it was written there under this key before."""
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_artifact(spark: SparkSession, folder: str, features: list[str]) -> tuple[DataFrame, dict]:
    """A reranker's (feature, weight, mean, std) for each of `features` and its summary; missing ones weigh 0, std is at least 1e-6."""
    rows = spark.read.option("header", True).schema("feature string, weight double, mean double, std double").csv(f"{folder}/feature_weights.csv")
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    filled = names.join(rows, "feature", "left").select("feature", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.greatest(F.coalesce("std", F.lit(1.0)), F.lit(1e-6)).alias("std"))
    text = "".join(r.value for r in spark.read.text(f"{folder}/summary.json").collect())  # one small file
    return filled, json.loads(text)


def write_artifact(weights: dict[str, tuple[float, float, float]], summary: dict, folder: str, spark: SparkSession) -> None:
    """What read_artifact() reads: feature -> (weight, mean, std), and the summary."""
    lines = ["feature,weight,mean,std"] + [f"{f},{w!r},{m!r},{s!r}" for f, (w, m, s) in weights.items()]
    write_text(spark, f"{folder}/feature_weights.csv", "\n".join(lines) + "\n")
    write_text(spark, f"{folder}/summary.json", json.dumps(summary, sort_keys=True, default=str))


def publish(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table: the new one is written beside it and takes its name when it is whole, so a failed write leaves the old one."""
    draft, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("draft", "old"))
    df.write.parquet(draft)
    files, made = _files(df.sparkSession, path)
    had = files.exists(made(path)) and files.rename(made(path), made(old))
    if not files.rename(made(draft), made(path)):
        raise OSError(f"{draft} could not take the name {path}")
    if had:
        files.delete(made(old), True)


def write_profiles_csv(profiles: DataFrame, path: str) -> None:
    """Profiles as CSV: PROFILE_COLUMNS, arrays joined by |, with a byte-order mark; what profiles lack is 0, or empty for texts."""
    def column(name: str):
        own = "item_id" if name == "movieId" else name
        if own not in profiles.columns:
            return F.col("comprehensive_score") if name == "preference_adjusted_comprehensive_score" else F.lit("" if name in ("title", "genres", "tags") else 0.0)
        return F.array_join(own, "|") if isinstance(profiles.schema[own].dataType, T.ArrayType) else F.col(own)

    named = ["\ufeff" + PROFILE_COLUMNS[0], *PROFILE_COLUMNS[1:]]  # the mark is the header's first character
    profiles.select(*[column(c).alias(n) for c, n in zip(PROFILE_COLUMNS, named)]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_rows_csv(tables: list[DataFrame], path: str) -> None:
    """Rows of tables with differing columns as one CSV; what a table lacks stays empty."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    every.write.mode("overwrite").option("header", True).csv(path)


def write_dashboard(profiles: DataFrame, ratings: DataFrame, folder: str) -> None:
    """JSON of the best 100 items, the 1,200 most rated ones and a summary row."""
    profiles.orderBy(F.desc("comprehensive_score"), "item_id").limit(100).write.mode("overwrite").json(f"{folder}/top")
    profiles.orderBy(F.desc("rating_count"), "item_id").limit(1200).write.mode("overwrite").json(f"{folder}/catalogue")
    summary = ratings.agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("user_id").alias("users")).crossJoin(profiles.agg(F.count(F.lit(1)).alias("items")))
    summary.write.mode("overwrite").json(f"{folder}/summary")


def write_metadata(spark: SparkSession, values: dict[str, object], path: str) -> None:
    """Keys and values as a two-column table."""
    spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "key string, value string").write.mode("overwrite").parquet(path)


def write_summary(config: dict, rows: DataFrame, path: str, keys: tuple[str, ...] = ("precision_at_k", "hit_rate_at_k", "map_at_k")) -> None:
    """JSON of a run's settings and its best row by `keys`."""
    best = rows.agg(F.to_json(F.max_by(F.struct(*rows.columns), F.struct(*keys))).alias("best_metric"))
    best.withColumn("config", F.lit(json.dumps(config, sort_keys=True, default=str))).write.mode("overwrite").json(path)


def runtime_chart(rows: list[tuple[str, int, float]]) -> str:
    """An SVG of seconds by size for each named method."""
    most_n, most_s = max((r[1] for r in rows), default=1), max((r[2] for r in rows), default=1.0) or 1.0
    lines = []
    for k, name in enumerate(sorted({r[0] for r in rows})):
        points = " ".join(f"{40 + 540 * n / most_n:.1f},{340 - 300 * s / most_s:.1f}" for m, n, s in sorted(rows, key=lambda r: r[1]) if m == name)
        hue = 80 * k % 360
        lines.append(f'<polyline fill="none" stroke="hsl({hue},60%,45%)" points="{points}"/><text x="470" y="{30 + 18 * k}" fill="hsl({hue},60%,45%)">{name}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="600" height="360">{"".join(lines)}</svg>'
