"""Evaluation sets, demo rows, uploaded documents, and synthetic postings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.patterns import SKILLS

TITLES = ("Software Engineer", "Backend Engineer", "Frontend Engineer", "Data Engineer", "Platform Engineer", "Security Engineer", "Machine Learning Engineer", "DevOps Engineer")
COMPANIES = ("Acme Corp", "Globex", "Initech", "Umbrella", "Hooli", "Vandelay", "Stark Industries", "Wayne Enterprises")
PLACES = (("Austin", "TX"), ("Seattle", "WA"), ("New York", "NY"), ("Denver", "CO"), ("Boston", "MA"))
LEVELS, MODES = ("intern", "entry", "mid", "senior"), ("remote", "hybrid", "onsite")


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVAL_ITEMS).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")


def demo_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STAGED).option("multiLine", True).json(path)


class UnsupportedDocument(ValueError):
    status = 415


class EmptyDocument(ValueError):
    status = 422


def document_text(name: str, data: bytes, pdf_pages: Callable[[bytes], list[str]] | None = None) -> str:
    """Text files as UTF-8 with replacements; PDF pages, by an injected reader, joined by line breaks."""
    if name.lower().endswith(".txt"):
        return data.decode("utf-8", "replace")
    if name.lower().endswith(".pdf") and pdf_pages is not None:
        text = "\n".join(page or "" for page in pdf_pages(data)).strip()
        if not text:
            raise EmptyDocument(name)
        return text
    raise UnsupportedDocument(name)


def documents(spark: SparkSession, path: str, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """path, text, error for every file under path."""

    def work(frames):
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"]):
                try:
                    rows.append((name, document_text(name, bytes(data), pdf_pages), None))
                except ValueError as failure:
                    rows.append((name, None, type(failure).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, text string, error string")


def synthetic(spark: SparkSession, n: int, seed: int = 42, now: str = "2026-01-01 00:00:00") -> DataFrame:
    """n templated postings. Every pick is a hash of the row number and the seed, so partitioning changes nothing."""

    def pick(what: str, size: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(size)).cast("int")

    def of(what: str, values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), pick(what, len(values)) + 1)

    place = F.element_at(F.array(*[F.struct(F.lit(c).alias("city"), F.lit(s).alias("state")) for c, s in PLACES]), pick("place", len(PLACES)) + 1)
    paid, low = pick("paid", 100) < 85, (60_000 + 1000 * pick("low", 100)).cast("double")
    known = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.element_at(F.array(*[F.lit(s) for s in SKILLS]), F.pmod(F.xxhash64(F.lit(seed), i, F.col("id")), F.lit(len(SKILLS))).cast("int") + 1))
    return spark.range(n).select(
        "id",
        F.concat(F.lit("synthetic-"), F.col("id")).alias("source_job_id"),
        of("title", TITLES).alias("title"),
        of("company", COMPANIES).alias("company"),
        F.lit("indeed").alias("source"),
        F.concat(F.lit("https://example.com/job/"), F.col("id")).alias("url"),
        (F.lit(now).cast("timestamp") - F.make_dt_interval(pick("age", 91))).alias("posted_at"),
        place["city"].alias("city"),
        place["state"].alias("state"),
        F.lit("US").alias("country"),
        of("mode", MODES).alias("work_mode"),
        of("level", LEVELS).alias("experience_level"),
        F.lit("FULLTIME").alias("job_type"),
        F.when(paid, low).alias("salary_min"),
        F.when(paid, low + 1000 * pick("more", 60)).alias("salary_max"),
        F.when(paid, "YEAR").alias("salary_period"),
        F.array_distinct(known).alias("required_skills"),
    )
