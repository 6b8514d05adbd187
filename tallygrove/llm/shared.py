"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, one of our own, but only if all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext.getCheckpointDir()):
        found = own
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallygrove-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: it survives lost executors and has no lineage."""
    spark, kind = df.sparkSession, df.schema
    path = path or new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    del df
    freed(spark)
    return spark.read.schema(kind).parquet(path)


def freed(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM finds their owners unused, which could be long after; so it is made to look."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that written() made, once nothing reads them any more."""
    for table in tables:
        for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batch_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows to an Arrow batch than Spark's 10,000, as one row is a whole document; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run within; then as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def trim() -> None:
    """Gives freed memory back: a worker lives on for later tasks, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_held: dict[str, Callable[[], None]] = {}


def holding(operator: str, release: Callable[[], None]) -> None:
    """Says that this worker keeps things for later tasks of an operator, and how to let go of them. What other operators have kept
    in it goes now, so that a worker that serves one after the other doesn't keep the sum of all."""
    others = [name for name in _held if name != operator]
    for name in others:
        _held.pop(name)()
    if others:
        gc.collect()
        trim()
    _held[operator] = release


#: Rows of one part that one task merges.
FAN = 8


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> DataFrame:
    """part, data: one row for each part of rows (part, at, data), where `at` numbers the tasks that made them.

    Neighbours are merged FAN at a time, in as many rounds as it takes, so however many tasks have made rows, no task of a round
    holds more than FAN of one part. merge has to give the same whatever is put together first.
    """
    kind = schema("part int, at int, data binary")

    def some(table: pa.Table) -> pa.Table:
        data = merge(table.column("data").to_pylist())
        return pa.table({"part": table.column("part")[:1], "at": pa.array([table.column("at")[0].as_py() // FAN], pa.int32()), "data": pa.array([data], pa.binary())})

    last = parts.agg(F.max("at")).first()[0] or 0
    out = parts.select("part", "at", "data")
    while True:
        out = out.groupBy("part", F.expr(f"at div {FAN}")).applyInArrow(some, kind)
        last //= FAN
        if not last:
            return out.select("part", "data")


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast to these types: any other column is left behind, whatever its name."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in kinds.items()])


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
