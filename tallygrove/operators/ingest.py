"""From raw postings to stored listings: extraction, first-wins dedupe, insert if absent, reparse, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import extract as X
from ..functions.patterns import CLIP


def staged(raw: DataFrame, source: str) -> DataFrame:
    """Canonical raw postings as staging rows; every extractor applied in one projection."""
    description, title = F.coalesce("job_description", F.lit("")), F.coalesce("job_title", F.lit("N/A"))
    types = F.coalesce("job_employment_types", F.array().cast("array<string>"))
    remote = F.coalesce("job_is_remote", F.lit(False))
    step = raw.select(
        "*",
        X.location(F.col("job_city"), F.col("job_state"), F.col("job_country"), F.col("job_location"), title, description).alias("_place"),
        X.chosen_salary(F.col("job_min_salary"), F.col("job_max_salary"), F.col("job_salary_period"), F.col("job_salary_string"), description).alias("_pay"),
        X.sections(description).alias("_sections"),
    )
    return step.select(
        F.coalesce("job_id", F.lit("")).alias("source_job_id"),
        title.alias("title"),
        F.coalesce("employer_name", F.lit("N/A")).alias("company"),
        F.lit(source).alias("source"),
        F.coalesce("job_apply_link", F.lit("")).alias("url"),
        F.col("job_posted_at_datetime_utc").alias("posted_at"),
        F.col("job_offer_expiration_datetime_utc").alias("expires_at"),
        "_place.city",
        "_place.state",
        "_place.country",
        remote.alias("is_remote"),
        X.work_mode(remote, description).alias("work_mode"),
        X.job_type(title, types).alias("job_type"),
        X.experience_level(title, types).alias("experience_level"),
        F.nullif(description, F.lit("")).alias("description"),
        "_sections.responsibilities",
        "_sections.qualifications",
        "_sections.benefits",
        F.col("_pay.min").alias("salary_min"),
        F.col("_pay.max").alias("salary_max"),
        F.coalesce(F.nullif("job_salary_currency", F.lit("")), F.lit("USD")).alias("salary_currency"),
        F.col("_pay.period").alias("salary_period"),
        X.skills(description).alias("required_skills"),
        X.visa(description).alias("visa_sponsorship"),
        X.start_date(title, description).alias("start_date_text"),
    )


def iso_timestamp(c: Column) -> Column:
    """Lenient: what can't be read is null."""
    return F.try_to_timestamp(c)


def clipped(df: DataFrame) -> DataFrame:
    """Texts cut to their columns' lengths."""
    return df.withColumns({name: F.substring(name, 1, n) for name, n in CLIP.items() if name in df.columns})


def first_wins(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """One row for each key, the earliest by `arrival`, by a partial aggregate: a hot key is folded before the shuffle."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(arrival)).alias("_row")).select("_row.*")


def absent(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return df.join(stored.select(key).distinct(), key, "left_anti")


def insert_if_absent(batch: DataFrame, stored: DataFrame, arrival: str, key: str = "source_job_id") -> DataFrame:
    """The rows of a batch that go in: with an id, not stored, first of their id in the batch. The check is on the unclipped id."""
    some = batch.where((F.col(key).isNotNull()) & (F.col(key) != ""))
    return first_wins(absent(some, stored, key), key, arrival)


def insert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    saved = inserted.agg(F.count(F.lit(1)).alias("saved"))
    return batch.agg(F.count(F.lit(1)).alias("n")).join(saved).select("saved", (F.col("n") - F.col("saved")).alias("skipped"))


def with_ids(new: DataFrame, highest: int, order: list[str]) -> DataFrame:
    """Ids after the highest one in a stable order. Ranks are taken within ranges and offset, not over one partition."""
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    # Written: run twice, adaptive execution merges the ranges of wide rows and of their counts differently, and samples them anew.
    ranged = storage.written(ranged, "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("id", F.col("_before") + F.col("_i") + highest).drop("_p", "_i", "_before")


def reparsed(listings: DataFrame) -> DataFrame:
    """Each listing with the fields that are read anew, and `changed`."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    new = {
        "experience_level": X.experience_level(title),
        "job_type": X.type_from_title(title, F.col("job_type")),
        "work_mode": X.work_mode(F.col("is_remote"), text),
        "required_skills": X.skills(text),
        "visa_sponsorship": X.visa(text),
        "start_date_text": X.start_date(title, text),
    }
    same = [c.eqNullSafe(F.col(name)) for name, c in new.items()]
    changed = ~same[0]
    for s in same[1:]:
        changed = changed | ~s
    return listings.withColumn("changed", changed).withColumns(new)


def reparse_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("changed").alias("updated"), F.count_if(~F.col("changed")).alias("unchanged"), F.count(F.lit(1)).alias("total"))


def deleted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def cascaded(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new in place of old rows of the same key. Written to a new path by the caller: a table isn't overwritten as it is read."""
    return deleted(old, new, key).unionByName(new, allowMissingColumns=True)


def with_summaries(listings: DataFrame, summaries: DataFrame) -> DataFrame:
    """ai_summary from a side table of (id, ai_summary, at), the latest for each id."""
    last = summaries.groupBy("id").agg(F.max_by("ai_summary", "at").alias("_new"))
    return listings.join(last, "id", "left").withColumn("ai_summary", F.coalesce("_new", "ai_summary")).drop("_new")


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
