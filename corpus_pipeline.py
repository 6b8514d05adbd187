"""Raw documents to training data: each stage works on all that its predecessor kept and is written before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`, the last one the encoded documents. Only these
columns go through; others that docs may have are left behind. A row with a null id is never matched by a decision about an
id, so it stays where its text alone doesn't rule it out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import decontaminate, jaccard, langid, linededup, pieces
from tallygrove.llm.queries import id_crc, piece_digests
from tallygrove.llm.shared import dropped, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language has a posterior probability under LEAST_SCORE, go."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, learn=id_crc() % 4 != 2)
    out = langid.predict(docs, model, keep=COLUMNS[1:])
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document that loses all its lines goes."""
    out = linededup.deduplicate(docs.select(*COLUMNS), keep=COLUMNS[2:])
    out = out.where("n_removed = 0 OR n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of similarity 0.75 join, the one with the smallest id stays."""
    found = jaccard.cluster(docs)
    others = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    docs = docs.select(*COLUMNS)
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = marked.where(decontaminate.contaminated()).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces, CRC-32 of their ids, SHA-256 of the text they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digests(pieces.decode(pieces.encode(docs, model), model))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: Language ID and encoding can't be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(spark, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
