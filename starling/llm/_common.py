"""What the operators of this subpackage share: tables, materialised steps and word splitting."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Used only where a session on this machine alone has no spark.checkpoint.dir, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a cluster must name it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or DEFAULT_DIR


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the enclosing steps() ends, else with the application."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes()[-1].append(path)
    return path


#: Paths to delete with the application, and each thread's open steps().
_whole: list[str] = []
_own = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_own, "scopes"):
        _own.scopes = [_whole]
    return _own.scopes


def _delete(paths: list[str]) -> None:
    context, jvm = SparkContext._active_spark_context, SparkContext._gateway.jvm
    settings = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(settings).delete(path, True)


@atexit.register
def _at_end() -> None:
    try:
        _delete(_whole)
    except Exception:  # the JVM has gone, and its folder is the cluster's to clean
        pass


@contextmanager
def steps() -> Iterator[None]:
    """What materialise() writes inside is deleted at the end, but for what outlive() names: that is left to the scope around."""
    _scopes().append([])
    try:
        yield
    finally:
        _delete(_scopes().pop())


def outlive(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """materialise(), for a table that is read after the steps() around."""
    found, scopes = materialise(df, name, rows), _scopes()
    if len(scopes) > 1:
        scopes[-2].append(scopes[-1].pop())
    return found


#: Rows of a small table that one file and one task hold.
ROWS_IN_FILE = 8_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation, and later
    steps see the written size when they choose joins. `rows`, a bound on the rows of a df that
    is cheap to make, keeps small tables in few files: one for each ROWS_IN_FILE of them.
    """
    path = fresh_path(df.sparkSession, name)
    df = df if rows is None else df.coalesce(1 + rows // ROWS_IN_FILE)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to Python, whatever its rows, where the session leaves Spark's own 64 MB: batches of whole
#: texts are held several times over. A session that chose its own bound keeps it.
BATCH_BYTES = 4 << 20
BATCH_SETTING, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of about BATCH_BYTES; one text is never split."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) in SPARKS_OWN:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def unused(columns: list[str], name: str) -> str:
    """A column name that is not among `columns`, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def signed(x: int) -> int:
    """An unsigned 64-bit value as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x

