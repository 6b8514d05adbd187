"""Evaluation sets: passages to ask about, the postings that count as right, questions by an injected model, unanswerable items.

What is picked at random is picked by a digest of the seed and the id, so neither partitions nor arrival change it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count

PER_COMPANY, LEAST_WORDS = 4, 40


def drawn(seed: int, *ids: Column) -> Column:
    """A place in the seed's order."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def sampled(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows without replacement: one top k."""
    return df.orderBy(drawn(seed, F.col(id_col)), id_col).limit(n)


def picked(chunks: DataFrame, listings: DataFrame, n: int, seed: int, per_company: int = PER_COMPANY, least: int = LEAST_WORDS) -> DataFrame:
    """job_id, chunk_id, section, body, title, company of n postings, at most per_company of a company, each with one of its
    passages of `least` words or more that isn't its profile."""
    eligible = chunks.where((F.col("section") != "Profile") & (word_count(F.col("body")) >= least))
    passage = F.struct(F.col("id").alias("chunk_id"), "section", "body")
    # The smallest digest of a posting's passages, folded before the shuffle.
    one = eligible.groupBy("job_id").agg(F.min_by(passage, F.struct(drawn(seed, F.col("job_id"), F.col("id")), "id")).alias("_p"))
    rows = one.join(listings.select(F.col("id").alias("job_id"), "title", "company"), "job_id").withColumn("_at", drawn(seed, F.col("job_id")))
    order = Window.partitionBy("company").orderBy("_at", "job_id")
    some = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_company)
    return some.orderBy("_at", "job_id").limit(n).select("job_id", "_p.*", "title", "company")


def gold(picks: DataFrame, listings: DataFrame) -> DataFrame:
    """job_id, gold_id: a pick's posting and every posting of the same company and, case aside, title. As pairs, so that no list
    grows with a common title."""
    asked = picks.select("job_id", F.col("company").alias("_company"), F.lower("title").alias("_title"))
    same = (F.col("company") == F.col("_company")) & (F.lower("title") == F.col("_title"))
    return listings.select(F.col("id").alias("gold_id"), "title", "company").join(asked, same).select("job_id", "gold_id")


def first_line(reply: str) -> str:
    """A model's question: the first line without quotation marks about it."""
    lines = reply.strip().splitlines()
    return lines[0].strip().strip('"').strip() if lines else ""


def questions(picks: DataFrame, model: Callable[[dict], str], tries: int = 5) -> DataFrame:
    """picks with `question`, from a model that is asked with a pick's columns; null if no try gives one."""

    def ask(row: dict) -> str | None:
        for _ in range(tries):
            try:
                if found := first_line(model(row)):
                    return found
            except Exception:
                continue
        return None

    def work(frames):
        for frame in frames:
            yield frame.assign(question=pd.Series([ask(r) for r in frame.to_dict("records")], index=frame.index, dtype=object))

    return picks.mapInPandas(work, picks.select("*", F.lit(None).cast("string").alias("question")).schema)


def with_unanswerable(items: DataFrame, unanswerable: list[str]) -> DataFrame:
    """Answerable items and, numbered u001 on, questions that nothing answers."""
    rows = [(f"u{i:03d}", False, q) for i, q in enumerate(unanswerable, 1)]
    more = items.sparkSession.createDataFrame(rows, "id string, answerable boolean, question string")
    return items.unionByName(more, allowMissingColumns=True)
