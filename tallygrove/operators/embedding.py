"""Embedding in batches that are each written once, so that a run that died or failed asks the model for the missing ones only.

Passages are keyed by a digest of model and content: equal passages are embedded once, whatever postings they stand in. Their
contents are written in batches by digest; every batch is a job over all executors whose vectors are a table of their own
(`storage.once`). A batch that fails doesn't keep others from being done; the call then ends with an error that names it, and the
same call again runs it alone.

Defined results: a null content has no vector; rows without contents give no batch; other columns stay as they are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import vectors as V

#: Passages of a batch, about.
BATCH = 1_000_000
KIND = "key binary, embedding array<double>"


def key(model: str, content: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{model}\0"), content).cast("binary"), 256))


def batches(contents: DataFrame, model: str, path: str, size: int = BATCH) -> int:
    """Writes the distinct contents (a column `content`) by batch under path and gives the number of batches; both are kept."""
    spark = contents.sparkSession

    def keyed():
        rows = contents.where("content IS NOT NULL").select(key(model, F.col("content")).alias("key"), "content")
        return rows.groupBy("key").agg(F.first("content").alias("content"))

    rows, _ = storage.once(spark, f"{path}/contents", keyed)

    def dealt():
        number = -(-rows.count() // size)
        folder = f"{path}/by_batch"
        rows.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(max(number, 1)))).repartition("batch", F.xxhash64("key", F.lit(1)) % 64).write.mode("overwrite").partitionBy("batch").parquet(folder)
        return spark.range(1), json.dumps(number)

    return json.loads(storage.once(spark, f"{path}/dealt", dealt)[1])


def vectors(contents: DataFrame, embedder, path: str, size: int = BATCH) -> DataFrame:
    """key, embedding of every distinct content."""
    spark = contents.sparkSession
    number = batches(contents, embedder.name, path, size)
    failed = {}
    for i in range(number):

        def one(i=i):
            rows = spark.read.schema("key binary, content string, batch long").parquet(f"{path}/by_batch").where(F.col("batch") == i)
            return rows.select("key", V.embed(embedder)(F.col("content")).alias("embedding"))

        try:
            storage.once(spark, f"{path}/vectors/{i}", one)
        except Exception as failure:  # the other batches go on; the error is raised below
            failed[i] = failure
    if failed:
        first = next(iter(failed.values()))
        raise RuntimeError(f"batches to be embedded again: {sorted(failed)}; the first failed by {first}") from first
    return spark.read.schema(KIND).parquet(f"{path}/vectors/*/rows") if number else spark.createDataFrame([], KIND)


def attached(chunks: DataFrame, embedder, path: str, size: int = BATCH) -> DataFrame:
    """chunks with `embedding`, by a join on the digest of their content."""
    found = vectors(chunks.select("content"), embedder, path, size).withColumnRenamed("key", "_key")
    return chunks.withColumn("_key", key(embedder.name, F.col("content"))).join(found, "_key", "left").drop("_key")
