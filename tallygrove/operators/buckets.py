"""A table in buckets by the hash of its key, changed by rewriting only the buckets that a change touches.

    files/run=R/bucket=B     the rows of bucket B as run R wrote them
    manifest/version=V       bucket, run, rows: which files make up version V; and one row of the number of buckets and the tags

A change writes the touched buckets to a new run's folder, then the manifest's next version as one file; readers see the old
version or the new one, and read the folders that the manifest names, no others. A change that dies leaves files that no manifest
names, so it can simply be made again. `tag` names a change: one whose tag is already in the table isn't made twice, so a job
that is started again after its death finds its work done. One writer at a time; a second one's manifest is refused.

Keys may come more than once: a change replaces all rows of its keys. What is collected is the numbers of buckets, never rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: For a table of some gigabytes. A bucket should hold what a few tasks write, so larger tables take more.
BUCKETS = 32
_MANIFEST = "bucket int, run string, rows long, buckets int, tags array<string>"


@dataclass(frozen=True)
class State:
    number: int
    #: bucket to (run, rows); a bucket without rows isn't there.
    files: dict[int, tuple[str, int]]
    tags: frozenset[str]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.files.values())


@dataclass(frozen=True)
class Buckets:
    spark: SparkSession
    path: str
    #: The columns of a row, and those whose hash says its bucket.
    kind: str
    key: tuple[str, ...]
    buckets: int = BUCKETS

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.kind).columns

    def state(self) -> State:
        try:
            rows = self.spark.read.schema(f"{_MANIFEST}, version int").json(f"{self.path}/manifest")
        except AnalysisException:
            return State(0, {}, frozenset())
        # A row for each bucket, with no data in it.
        last = rows.groupBy("version").agg(F.collect_list(F.struct("bucket", "run", "rows", "buckets", "tags")).alias("rows")).orderBy(F.desc("version")).limit(1).collect()
        if not last:
            return State(0, {}, frozenset())
        (head,) = [r for r in last[0].rows if r.bucket is None]
        if head.buckets != self.buckets:
            raise ValueError(f"{self.path} has {head.buckets} buckets")
        return State(last[0].version, {r.bucket: (r.run, r.rows) for r in last[0].rows if r.bucket is not None}, frozenset(head.tags))

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.key), F.lit(self.buckets))


def read(table: Buckets, numbers: set[int] | None = None, state: State | None = None) -> DataFrame:
    """The rows; of the given buckets alone, if any are given."""
    state = table.state() if state is None else state
    paths = [f"{table.path}/files/run={run}/bucket={b}" for b, (run, _) in sorted(state.files.items()) if numbers is None or b in numbers]
    if not paths:
        return table.spark.createDataFrame([], table.kind)
    return table.spark.read.schema(table.kind).parquet(*paths)


def _publish(table: Buckets, state: State) -> State:
    rows = [(None, None, None, table.buckets, sorted(state.tags)), *((b, run, n, None, None) for b, (run, n) in state.files.items())]
    table.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").json(f"{table.path}/manifest/version={state.number}")
    return state


def _touched(table: Buckets, keys: DataFrame) -> set[int]:
    return {r[0] for r in keys.select(table.bucket()).distinct().collect()}


def change(table: Buckets, rows: DataFrame | None = None, keys: DataFrame | None = None, tag: str | None = None) -> State:
    """All rows of the keys of `rows` and of `keys` give way to `rows`.

    Both are read more than once, so they should be cheap or written. Rows with a null in the key are left out.
    """
    state = table.state()
    if tag is not None and tag in state.tags:
        return state
    key = list(table.key)
    new = None if rows is None else rows.select(*table.columns).dropna(subset=key)
    named = [df.select(*key) for df in (new, keys) if df is not None]
    if not named:
        raise ValueError("nothing to change")
    gone = (named[0].unionByName(named[1]) if len(named) > 1 else named[0]).dropna().distinct()
    touched = _touched(table, gone)
    kept = read(table, touched, state).join(gone, key, "left_anti").select(*table.columns)
    out = kept if new is None else kept.unionByName(new)
    files = {b: f for b, f in state.files.items() if b not in touched}
    if touched:
        run = uuid.uuid4().hex
        path = f"{table.path}/files/run={run}"
        # Small buckets share a task and a large one, or one with a hot key, is split over several, as adaptive execution finds them.
        dealt = out.withColumn("bucket", table.bucket()).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *key).write.partitionBy("bucket").parquet(path)
        # Counted from the files' own footers. Where every row went there are no files, hence the schema.
        counts = table.spark.read.schema(f"{table.kind}, bucket int").parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        files |= {r.bucket: (run, r.n) for r in counts.collect()}
    return _publish(table, State(state.number + 1, files, state.tags | {tag} if tag is not None else state.tags))


def create(spark: SparkSession, path: str, rows: DataFrame, key: tuple[str, ...], buckets: int = BUCKETS) -> Buckets:
    """A new table of rows at a path that is free."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = Buckets(spark, path, kind, tuple(key), buckets)
    if table.state().number:
        raise ValueError(f"{path} holds a table")
    change(table, rows)
    return table


def differing(table: Buckets, rows: DataFrame, state: State | None = None) -> DataFrame:
    """Of rows with one row a key: those that the table doesn't hold as they are, and `_new`, whether their key is missing.

    Only buckets of their keys are read.
    """
    key = list(table.key)
    rows = rows.select(*table.columns).dropna(subset=key)
    others = [c for c in table.columns if c not in key]
    old = read(table, _touched(table, rows), state).select(*key, F.struct(*others).alias("_old")) if others else read(table, None, state).select(*key, F.lit(True).alias("_old"))
    found = rows.join(old, key, "left")
    same = F.struct(*others).eqNullSafe(F.col("_old")) if others else F.lit(True)
    return found.where(F.col("_old").isNull() | ~same).select(*table.columns, F.col("_old").isNull().alias("_new"))


def upsert(table: Buckets, rows: DataFrame, tag: str | None = None) -> dict[str, int]:
    """Inserts and updates one row a key; rows that are stored as they are touch no bucket. Returns inserted, updated, unchanged."""
    state = table.state()
    if tag is not None and tag in state.tags:
        return {"inserted": 0, "updated": 0, "unchanged": rows.dropna(subset=list(table.key)).count()}
    other = storage.written(differing(table, rows, state), "differing")
    counts = {r[0]: r[1] for r in other.groupBy("_new").count().collect()}
    change(table, other.drop("_new"), tag=tag)
    inserted, updated = counts.get(True, 0), counts.get(False, 0)
    return {"inserted": inserted, "updated": updated, "unchanged": rows.dropna(subset=list(table.key)).count() - inserted - updated}
