"""The test tables seen as the engine's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import termindex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as postings. Unknown values come from the data: an open order has no maximum, a low one no minimum."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # The size of customers grows with orders, so whether it is broadcast is left to the optimizer.
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("job-"), F.col("o_orderkey")).alias("source_job_id"),
        F.col("o_orderpriority").alias("title"),
        F.col("c_mktsegment").alias("company"),
        F.col("o_orderstatus").alias("work_mode"),
        F.lower(F.col("c_mktsegment")).alias("experience_level"),
        F.col("o_orderdate").alias("posted_at"),
        F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice")).alias("salary_min"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") * 2).alias("salary_max"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("visa_sponsorship"),
        F.concat(F.when(F.month("o_orderdate") < 7, "Summer ").otherwise("Fall "), F.year("o_orderdate").cast("string")).alias("start_date_text"),
        F.when(F.col("c_acctbal") > 0, F.split(F.lower(F.col("o_orderpriority")), "-")).alias("required_skills"),
    )


LISTINGS = """
listings AS (SELECT o_orderkey AS id, 'job-' || o_orderkey AS source_job_id, o_orderpriority AS title, c_mktsegment AS company, o_orderstatus AS work_mode,
  lower(c_mktsegment) AS experience_level, o_orderdate AS posted_at, CASE WHEN o_totalprice >= 20000 THEN o_totalprice END AS salary_min,
  CASE WHEN o_orderstatus <> 'O' THEN o_totalprice * 2 END AS salary_max, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS visa_sponsorship,
  CASE WHEN month(o_orderdate) < 7 THEN 'Summer ' ELSE 'Fall ' END || year(o_orderdate) AS start_date_text,
  CASE WHEN c_acctbal > 0 THEN string_split(lower(o_orderpriority), '-') END AS required_skills
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first line is the title, the source the company."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("company"), F.col("text").alias("description"), "lang")


POSTINGS = """
postings AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS company, text AS description, lang FROM documents)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as passages of postings: a label's vectors are one company's."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("job_id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("company"), "label")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a source's staged postings."""
    p = postings(spark, sf_dir)
    return p.select(
        F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("source_job_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        "company",
        "lang",
        F.col("id").alias("doc_id"),
        F.col("company").alias("source"),
        F.concat(F.lit("https://jobs.example.org/"), F.col("id").cast("string")).alias("url"),
        F.lit(False).alias("is_remote"),
        "description",
    )


def link_status(method: str, url: str) -> int:
    """Stands in for the net: links that end in 7 are dead, those in 5 refuse HEAD."""
    return 404 if url.endswith("7") else 405 if url.endswith("5") and method == "HEAD" else 200


_INDEXES: dict[tuple, termindex.TermIndex] = {}


def term_index(spark: SparkSession, sf_dir: str) -> termindex.TermIndex:
    """The stored index of documents, built once for each session and state of the table's files."""
    d = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(d.inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = termindex.create(spark, storage.new_path(spark, "terms"), d, "doc_id", "text")
    return _INDEXES[key]
