"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a document are hashed (128 bits). A window that occurs more than once in the corpus keeps
its first occurrence, by id and then by place; of each later one, all three lines go. Covered lines of overlapping windows
merge, so each line goes once. Windows are judged on the input, not on what is left of it.

Each document's own repeats are folded before the shuffle, and a common window is one row a document and task on its way to
the count; what is joined back is one row for each occurrence that goes, which Spark may split among tasks.

Defined results: a null text has 0 lines and stays null; an empty text has one empty line; a document of fewer than three
lines has no window and stays whole; three empty lines are no window; rows without an id take no part and stay whole; equal
rows that repeat an id count as one occurrence, so both stay or both lose the same lines; columns that aren't named are left
behind; an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batch_rows, holding

LINES = 3
ADDED = ("n_lines", "n_removed")


def windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place and two hashes of every window that isn't all empty."""
    lines = df.select(F.col(id_col).alias("id"), F.split(text_col, "\n", -1).alias("ls")).where(F.col("id").isNotNull() & (F.size("ls") >= LINES))
    each = F.expr(
        f"filter(transform(sequence(0, size(ls) - {LINES}), i -> struct(i AS place, xxhash64(ls[i], ls[i+1], ls[i+2]) AS h1, xxhash64(ls[i+2], 7, ls[i+1], ls[i]) AS h2,"
        " ls[i] != '' OR ls[i+1] != '' OR ls[i+2] != '' AS some)), w -> w.some)"
    )
    return lines.select("id", F.explode(each).alias("w")).select("id", "w.place", "w.h1", "w.h2")


def later_windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and place of every window that also occurs earlier."""
    every = windows(df, id_col, text_col)
    first = every.groupBy("h1", "h2").agg(F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return every.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(F.struct("id", "place") != F.col("first")).select("id", "place")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of df: its id, what is left of its text, the columns in `keep`, `n_lines` and `n_removed`."""
    if set(ADDED) & {id_col, text_col, *keep}:
        raise ValueError(f"{ADDED} are names of the result")
    batch_rows(df.sparkSession)
    gone = later_windows(df, id_col, text_col).groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("_places"))
    picked = df.select(id_col, text_col, *keep)
    joined = picked.join(gone.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left").drop("_id")
    kind = T.StructType([f for f in picked.schema.fields] + [T.StructField(c, T.LongType()) for c in ADDED])

    def work(batches):
        holding("linededup", lambda: None)
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = text.split("\n") if text is not None else []
                counts.append(len(lines))
                if places and lines:
                    covered = bytearray(len(lines))
                    for place in places:
                        covered[place : place + LINES] = b"\1" * len(covered[place : place + LINES])
                    text = "\n".join(line for line, c in zip(lines, covered) if not c)
                    removed.append(sum(covered))
                else:
                    removed.append(0)
                texts.append(text)
            out = [batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:-1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, kind.names)

    return joined.mapInArrow(work, kind)
