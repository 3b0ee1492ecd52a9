"""What several operators need: the shared folder, written intermediates and small batches."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters; words are what lies between them.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Shorten Arrow batches and make this package importable on the executors."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    package = Path(__file__).resolve().parents[1]
    places = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(package.parent) not in places and not getattr(spark.sparkContext, "_millrace_shipped", False):
        to = os.path.join(tempfile.mkdtemp(prefix="spark-"), "millrace.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(to)  # served by the driver to every executor
        if to in sys.path:
            sys.path.remove(to)  # the driver has the package itself
        spark.sparkContext._millrace_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark.sparkContext, "_millrace_dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._millrace_dir = root
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps survive lost executors."""
    path = new_path(session(df), name)
    df.write.parquet(path)
    if (kept := _kept.get()) is not None:
        kept.append(path)
    return session(df).read.schema(df.schema).parquet(path)


#: Where the work at hand notes what it writes; each thread and each run has its own.
_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


@contextmanager
def noted():
    """The paths that ``materialise`` writes within."""
    paths: list[str] = []
    token = _kept.set(paths)
    try:
        yield paths
    finally:
        _kept.reset(token)


def is_noted() -> bool:
    return _kept.get() is not None


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete what is no longer read."""
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def written_at(spark: SparkSession, path: str) -> float:
    """When a file was written, in seconds."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime() / 1000


def numbered(rows: DataFrame, order: list, name: str, file: str) -> DataFrame:
    """``rows``, written, with their place (0, 1, ...) in an order over all of them. Range partitions are sorted each on its own; the driver has their sizes."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())  # partition and place within
    placed = materialise(placed, file)
    part = F.shiftright(name, 33)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        offsets.append(f"{r['part']}L, {before}L")
        before += r["n"]
    if not offsets:
        return placed
    return placed.withColumn(name, F.try_element_at(F.expr(f"map({', '.join(offsets)})"), part) + F.col(name).bitwiseAND((1 << 33) - 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def utf8_list(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def same(a, b):
    """Equality that also holds between nulls; Spark joins on it without a nested loop."""
    return a.eqNullSafe(b)


def text_key(text="text"):
    """A 64-bit key of a text (string or bytes), to tell apart rows that repeat an id."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit("").cast("binary")))


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], value: str, hot) -> DataFrame:
    """``rows`` with the value of their keys in ``table``, which has each of them once.

    ``hot`` tells the keys that very many rows share; there must be few. Every
    task holds those, and their rows are spread over the other join, where they meet nothing.
    """
    near = table.where(hot).select(*keys, F.struct(F.col(value)).alias("__near"))
    met = rows.join(F.broadcast(near), keys, "left")
    spread = F.when(F.col("__near").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000))).cast("long")
    far = table.where(~hot).select(*keys, F.lit(0).cast("long").alias("__spread"), F.struct(F.col(value)).alias("__far"))
    met = met.withColumn("__spread", spread).join(far, [*keys, "__spread"], "left")
    return met.select(*rows.columns, F.coalesce("__near", "__far")[value].alias(value))
