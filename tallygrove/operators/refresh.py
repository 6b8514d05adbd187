"""The refresh: sources, live links, insert, reparse, index, in this order, as stages that are each written once.

A run has a name. Every stage's result is a table under that name (`storage.once`) and every change of a stored table carries it as
its tag, so a run that died is started again under its name, skips what is done, and ends in the same tables. A new run is refused
while another one is unfinished.

    listings   the postings, in buckets by source_job_id        chunks, vectors   the index, in buckets by job_id
    templates  kept paragraph counts                            runs              the stages of each run

Only postings that are new, read anew, without a vector, or that hold a paragraph that became or ceased to be a template are cut
into passages; of these only the ones whose content hash differs are embedded, in batches that are each written once.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, storage
from ..functions import vectors as V
from ..sources import liveness
from . import buckets, chunking, embedding, index, ingest, listing, templates

#: Takes the stored ids (source_job_id), gives staged postings and whether the feed's quota is used up.
Fetch = Callable[[DataFrame], tuple[DataFrame, bool]]
QUOTA = "quota"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    listings: buckets.Buckets
    chunks: buckets.Buckets
    vectors: buckets.Buckets
    templates: templates.Templates


def opened(spark: SparkSession, path: str, number: int = buckets.BUCKETS, separator: str = "\n\n") -> Store:
    """The store at a path; one that isn't there yet is empty."""

    def table(name: str, kind: str, *key: str) -> buckets.Buckets:
        return buckets.Buckets(spark, f"{path}/{name}", kind, key, number)

    return Store(spark, path, table("listings", schemas.LISTING, "source_job_id"), table("chunks", schemas.CHUNK, "job_id"), table("vectors", schemas.VECTOR, "job_id"), templates.opened(spark, f"{path}/templates", separator, number=number))


def seeded(store: Store, listings: DataFrame) -> Store:
    """Puts postings into the store, with columns of LISTING (others are dropped, missing ones null); the next run indexes them."""
    rows = store.spark.createDataFrame([], schemas.LISTING)
    listings = listings.select(*[c for c in rows.columns if c in listings.columns])
    rows = rows.unionByName(listings, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])
    buckets.change(store.listings, ingest.clipped(rows))
    return store


def _claimed(store: Store, run: str) -> None:
    """Notes the run as begun; an error if another one is unfinished."""
    spark, path = store.spark, f"{store.path}/runs"
    try:
        begun = {r.run for r in spark.read.schema("run string").json(f"{path}/begun").collect()}
    except AnalysisException:
        begun = set()
    open_ = sorted(r for r in begun - {run} if storage.done(spark, f"{path}/{r}/summary") is None)
    if open_:
        raise ValueError(f"unfinished, to be resumed first: {', '.join(open_)}")
    if run not in begun:
        spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").json(f"{path}/begun")


def _fetched(store: Store, at: str, sources: list[tuple[str, Fetch]]) -> tuple[DataFrame, dict]:
    """What the sources have that isn't stored, and their counts. One that fails is named and passed over; the next run asks it
    again. A used-up quota stops the rest. What was fetched before a run died isn't asked for again."""
    spark = store.spark
    all_rows = spark.createDataFrame([], f"{schemas.STAGED}, _source int")
    columns = all_rows.columns
    known = buckets.read(store.listings).select("source_job_id")

    def asked(i: int, fetch: Fetch):
        rows, quota = fetch(known)
        rows = all_rows.unionByName(rows.select(*[c for c in columns if c in rows.columns]), allowMissingColumns=True)
        return ingest.absent(rows, known, "source_job_id").withColumn("_source", F.lit(i)).select(*columns), QUOTA if quota else None

    ended = storage.done(spark, f"{at}/asked")
    if ended is None:
        said = {"sources": {}, "failed": {}, "quota_exceeded": False, "read": []}
        for i, (name, fetch) in enumerate(sources):
            try:
                rows, note = storage.once(spark, f"{at}/source-{i}", lambda i=i, fetch=fetch: asked(i, fetch))
            except Exception as failure:  # one source's fault is not the run's
                said["failed"][name] = f"{type(failure).__name__}: {str(failure)[:2000]}"
                continue
            said["read"].append(i)
            said["sources"][name] = said["sources"].get(name, 0) + rows.count()
            if note == QUOTA:
                said["quota_exceeded"] = True
                break
        ended = storage.once(spark, f"{at}/asked", lambda: (spark.range(1), json.dumps(said)))
    said = json.loads(ended[1])
    for i in said.pop("read"):
        all_rows = all_rows.unionByName(storage.done(spark, f"{at}/source-{i}")[0])
    return all_rows, said


def _new_listings(store: Store, live: DataFrame, now: dt.datetime) -> DataFrame:
    """Rows to insert, with ids behind the highest: first of their id by place of the source, then by a hash of the row."""
    stored = buckets.read(store.listings)
    order = F.struct("_source", F.xxhash64(*[c for c in live.columns if c != "_source"]))
    new = ingest.insert_if_absent(live.withColumn("_arrival", order), stored, "_arrival").drop("_arrival", "_source")
    new = ingest.with_ids(new, stored.agg(F.max("id")).first()[0] or 0, ["source_job_id"])
    new = new.withColumns({c: ingest.iso_timestamp(F.col(c)) for c in ("posted_at", "expires_at")})
    new = ingest.clipped(new.withColumns({"scraped_at": F.lit(now).cast("timestamp"), "ai_summary": F.lit(None).cast("string")}))
    return new.select(*[F.col(f.name).cast(f.dataType) for f in stored.schema.fields])


def _indexed(store: Store, at: str, run: str, embedder, changed: DataFrame, now: dt.datetime, least: int) -> dict:
    """Brings templates, chunks and vectors up to the listings."""
    spark = store.spark
    postings = buckets.read(store.listings).where(listing.not_synthetic())
    missing, _ = storage.once(spark, f"{at}/missing", lambda: postings.join(buckets.read(store.vectors).select(F.col("job_id").alias("id")), "id", "left_anti").select("id"))
    added = postings.join(missing, "id", "left_semi").select("id", "description")
    crossing = templates.change(store.templates, added, least=least, tag=run)
    stale = missing.unionByName(changed.where(listing.not_synthetic()).select("id")).unionByName(templates.crossed(store.templates, crossing)).distinct()
    stale, _ = storage.once(spark, f"{at}/stale", lambda: stale)
    cut = postings.join(stale, "id", "left_semi")
    chunks, _ = storage.once(spark, f"{at}/chunks", lambda: chunking.chunked(cut, templates.own(store.templates, stale, least)))
    todo, _ = storage.once(spark, f"{at}/todo", lambda: index.stale(index.hashes(chunks, embedder.name), buckets.read(store.vectors)))

    def embedded():
        own = chunks.join(todo.select("job_id"), "job_id", "left_semi")
        own = embedding.attached(own, embedder, f"{at}/embedding")
        return own.withColumn("id", chunking.passage_id(F.col("job_id"), F.col("chunk_index")))

    fresh, _ = storage.once(spark, f"{at}/embedded", embedded)
    means, _ = storage.once(spark, f"{at}/means", lambda: V.mean_vectors(fresh, "job_id", "embedding").join(todo, "job_id").withColumn("indexed_at", F.lit(now).cast("timestamp")))
    buckets.change(store.chunks, fresh, todo.select("job_id"), tag=run)
    buckets.change(store.vectors, means, todo.select("job_id"), tag=run)
    return {"cut": stale.count(), "embedded": todo.count(), "chunks": fresh.count()}


def refresh(store: Store, run: str, sources: list[tuple[str, Fetch]], client: Callable[[str, str], int], now: dt.datetime, embedder=None, least: int = chunking.TEMPLATE_POSTINGS) -> dict:
    """The run's counts. A failing index is reported under "index" and leaves the run unfinished: listings and search go on, and
    the same call again takes up there."""
    spark, at = store.spark, f"{store.path}/runs/{run}"
    _claimed(store, run)
    if (ended := storage.done(spark, f"{at}/summary")) is not None:
        return json.loads(ended[1])
    (rows, said) = _fetched(store, at, sources)
    live, _ = storage.once(spark, f"{at}/live", lambda: liveness.alive(rows, client).select(*rows.columns))
    new, _ = storage.once(spark, f"{at}/new", lambda: _new_listings(store, live, now))
    buckets.change(store.listings, new, tag=f"{run}/insert")
    scraped, saved = live.count(), new.count()
    changed, _ = storage.once(spark, f"{at}/reparsed", lambda: ingest.reparsed(buckets.read(store.listings)).where("changed").select(*store.listings.columns))
    buckets.change(store.listings, changed, tag=f"{run}/reparse")
    summary = {"scraped": scraped, "saved": saved, "skipped": scraped - saved, **said, "reparsed": changed.count()}
    if embedder is not None:
        try:
            summary["index"] = _indexed(store, at, run, embedder, changed, now, least)
        except Exception as failure:
            return summary | {"index": {"error": f"{type(failure).__name__}: {str(failure)[:2000]}"}}
    storage.once(spark, f"{at}/summary", lambda: (spark.range(1), json.dumps(summary)))
    return summary
