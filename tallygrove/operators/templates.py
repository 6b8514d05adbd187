"""Template paragraphs kept up to date: how many postings have each paragraph, without counting all postings anew.

    held     id, key     the long paragraphs of each posting, by the digest of their normal form, in buckets by id
    counts   key, n      how many postings hold a paragraph, in buckets by digest

A change takes its postings' old paragraphs from `held`, adds their new ones, and moves the counts by the difference; only the
buckets of moved counts are rewritten. A paragraph whose count crosses the limit makes the passages of every posting that holds it
stale: crossed() names these postings. Hot paragraphs are folded before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from . import buckets, chunking
from .buckets import Buckets


@dataclass(frozen=True)
class Templates:
    path: str
    held: Buckets
    counts: Buckets
    separator: str = "\n\n"
    unescape: bool = True


def paragraphs(postings: DataFrame, text_col: str, separator: str = "\n\n", unescape: bool = True) -> DataFrame:
    """id, key: the digests of each posting's distinct paragraphs of 12 words and more. Rows of one id count as one posting."""
    return chunking.long_paragraphs(postings.where("id IS NOT NULL"), "id", text_col, separator, unescape).distinct()


def opened(spark: SparkSession, path: str, separator: str = "\n\n", unescape: bool = True, number: int = buckets.BUCKETS) -> Templates:
    """The counts at a path; where there are none yet, those of no postings."""
    return Templates(path, Buckets(spark, f"{path}/held", "id long, key binary", ("id",), number), Buckets(spark, f"{path}/counts", "key binary, n long", ("key",), number), separator, unescape)


def change(kept: Templates, changed: DataFrame | None = None, removed: DataFrame | None = None, text_col: str = "description", least: int = chunking.TEMPLATE_POSTINGS, tag: str | None = None) -> DataFrame:
    """Adds or replaces the postings of `changed` (id and a text), takes out the ids of `removed`, and returns the paragraphs whose
    count crossed `least`: key, before, n.

    The moves are written before either table changes. With a tag they are written where a second call with it finds them, so a
    change that died may be made again: it moves each table once and returns the same.
    """
    spark = kept.held.spark
    named = [df.select(F.col("id").cast("long").alias("id")) for df in (changed, removed) if df is not None]
    ids = storage.written((named[0].unionByName(named[1]) if len(named) > 1 else named[0]).dropna().distinct(), "ids")
    new = spark.createDataFrame([], kept.held.kind)
    if changed is not None:
        new = paragraphs(changed, text_col, kept.separator, kept.unescape)
    if removed is not None:
        new = new.join(removed.select(F.col("id").cast("long").alias("id")).dropna().distinct(), "id", "left_anti")
    new = storage.written(new.select("id", "key"), "paragraphs")
    old = buckets.read(kept.held).join(ids, "id", "left_semi")
    moves = new.select("key", F.lit(1).alias("by")).unionByName(old.select("key", F.lit(-1).alias("by"))).groupBy("key").agg(F.sum("by").alias("by")).where("by <> 0")
    before = buckets.read(kept.counts).withColumnRenamed("n", "before")
    moved = moves.join(before, "key", "left").select("key", F.coalesce("before", F.lit(0).cast("long")).alias("before"), "by")
    moved = moved.select("key", "before", (F.col("before") + F.col("by")).alias("n"))
    moved = storage.written(moved, "moved") if tag is None else storage.once(spark, f"{kept.path}/moves/{tag}", lambda: moved)[0]
    buckets.change(kept.counts, moved.where("n > 0"), moved.select("key"), tag)
    buckets.change(kept.held, new, ids, tag)
    return moved.where((F.col("before") >= least) != (F.col("n") >= least))


def counted(kept: Templates, least: int = chunking.TEMPLATE_POSTINGS) -> DataFrame:
    """key, n of the paragraphs that so many postings have."""
    return buckets.read(kept.counts).where(F.col("n") >= least)


def own(kept: Templates, ids: DataFrame, least: int = chunking.TEMPLATE_POSTINGS) -> DataFrame:
    """id, key: the templates among the paragraphs of the postings of `ids`, as passages are cut with; no text is read."""
    return buckets.read(kept.held).join(ids.select("id"), "id", "left_semi").join(counted(kept, least), "key", "left_semi").select("id", "key")


def crossed(kept: Templates, crossing: DataFrame) -> DataFrame:
    """The ids of the postings that hold one of these paragraphs: a semi-join over two narrow columns."""
    return buckets.read(kept.held).join(crossing.select("key"), "key", "left_semi").select("id").distinct()
