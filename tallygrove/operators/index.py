"""The passage index, kept up to date by content hashes, with plain tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import vectors as V
from . import chunking, ingest, listing


@dataclass
class Index:
    chunks: DataFrame
    vectors: DataFrame


def hashes(chunks: DataFrame, model: str) -> DataFrame:
    """job_id, content_hash, n_chunks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"])
    return chunks.groupBy("job_id").agg(chunking.content_hash(model, ordered).alias("content_hash"), F.count(F.lit(1)).cast("int").alias("n_chunks"))


def stale(new: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """The rows of new whose key has no or another hash in old."""
    before = old.select(F.col("job_id"), F.col("content_hash").alias("_old"))
    found = new.join(before, "job_id", "left")
    return (found if force else found.where(~F.col("content_hash").eqNullSafe(F.col("_old")))).drop("_old")


def build(listings: DataFrame, embedder, old: Index | None = None, synthetic: bool = False, force: bool = False, least: int = chunking.TEMPLATE_POSTINGS, now=None) -> Index:
    """The index of listings: passages and vectors of unchanged postings are taken over, those of missing ones go.

    Templates are counted over all postings, so one new posting can make others stale.
    """
    postings = listings if synthetic else listings.where(listing.not_synthetic())
    # Each is read several times below: written, so that passages are cut once and the embedder sees each passage once.
    chunks = storage.written(chunking.cut(postings, least), "chunks")
    marks = hashes(chunks, embedder.name)
    todo = marks if old is None else stale(marks, old.vectors, force)
    fresh = storage.written(chunks.join(todo.select("job_id"), "job_id", "left_semi").withColumn("embedding", V.embed(embedder)(F.col("content"))), "embedded")
    stamp = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    vectors = V.mean_vectors(fresh, "job_id", "embedding").join(todo, "job_id").withColumn("indexed_at", stamp)
    # A passage's id follows from its posting and place, so a rebuild gives the same one.
    fresh = fresh.withColumn("id", chunking.passage_id(F.col("job_id"), F.col("chunk_index")))
    if old is None:
        return Index(fresh, vectors)
    kept_chunks = ingest.cascaded(ingest.deleted(old.chunks, todo, "job_id"), postings, "job_id")
    kept_vectors = ingest.cascaded(ingest.deleted(old.vectors, todo, "job_id"), postings, "job_id")
    return Index(kept_chunks.unionByName(fresh), kept_vectors.unionByName(vectors))
