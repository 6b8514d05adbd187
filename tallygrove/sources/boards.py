"""Company boards of three kinds as canonical raw postings, from recorded or fetched JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..functions.extract import employment_type, is_cs_title
from ..functions.patterns import LEVER_TYPES

# How boards are named.
NAMES = {
    "lever": {"palantir": "Palantir"},
    "ashby": {"ramp": "Ramp", "notion": "Notion", "plaid": "Plaid", "linear": "Linear", "openai": "OpenAI", "hex": "Hex"},
    "greenhouse": {
        "stripe": "Stripe", "airbnb": "Airbnb", "coinbase": "Coinbase", "robinhood": "Robinhood", "affirm": "Affirm", "gitlab": "GitLab", "asana": "Asana",
        "brex": "Brex", "pinterest": "Pinterest", "reddit": "Reddit", "cloudflare": "Cloudflare", "figma": "Figma", "databricks": "Databricks",
        "discord": "Discord", "dropbox": "Dropbox", "instacart": "Instacart", "lyft": "Lyft", "twitch": "Twitch", "datadog": "Datadog", "mongodb": "MongoDB",
        "squarespace": "Squarespace",
    },
}
# End of fixed values.
ASHBY_TYPES = {k.replace("-", ""): v for k, v in LEVER_TYPES.items()}


def board_name(board: Column, kind: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NAMES[kind].items() for x in pair])
    return F.coalesce(F.try_element_at(table, board), F.initcap(board))


def _or(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def _raw(df: DataFrame, **given: Column) -> DataFrame:
    """All canonical columns; those not given are null."""
    out = []
    for column in schemas.RAW.split(", "):
        name, kind = column.split(" ", 1)
        out.append((given[name] if name in given else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def lever(df: DataFrame, company: Column) -> DataFrame:
    """df: one row a posting, as schemas.LEVER. The description is the plain texts and each list under its label."""
    place = F.coalesce("categories.location", F.lit(""))
    lists = df.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode_outer("lists").alias("_at", "_list"))
    lists = lists.withColumn("_body", X.html_to_text(F.col("_list.content")))
    # The entity decoder takes no arrays, so lists are taken apart and put together by posting.
    part = F.when(F.col("_body") != "", F.concat(F.lit("\n"), F.coalesce("_list.text", F.lit("")), F.lit("\n"), F.col("_body")))
    joined = lists.withColumn("_part", part).groupBy("_row").agg(
        *[F.first(c).alias(c) for c in df.columns], F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda s: s["_part"]).alias("_parts")
    )
    texts = F.concat(F.array(F.col("descriptionPlain"), F.col("additionalPlain")), F.col("_parts"))
    return _raw(
        joined,
        job_id=F.concat(F.lit("lever-"), F.col("id")),
        job_title=F.coalesce(F.nullif("text", F.lit("")), F.lit("N/A")),
        employer_name=company,
        job_apply_link=_or(F.col("hostedUrl"), F.col("applyUrl")),
        job_posted_at_datetime_utc=F.when(F.col("createdAt") != 0, F.date_format(F.timestamp_millis("createdAt"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")),
        job_location=place,
        job_is_remote=F.coalesce(F.col("workplaceType") == "remote", F.lit(False)) | F.lower(place).contains("remote"),
        job_employment_types=employment_type(F.col("categories.commitment"), LEVER_TYPES),
        job_description=F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"),
    )


def ashby(df: DataFrame, company: Column) -> DataFrame:
    """df: rows of schemas.ASHBY."""
    jobs = df.select(F.explode("jobs").alias("j")).select("j.*")
    place = F.coalesce("location", F.lit(""))
    kind = F.regexp_replace(F.coalesce("employmentType", F.lit("")), "[- ]", "")
    return _raw(
        jobs,
        job_id=F.concat(F.lit("ashby-"), F.col("id")),
        job_title=F.coalesce(F.nullif("title", F.lit("")), F.lit("N/A")),
        employer_name=company,
        job_apply_link=_or(F.col("jobUrl"), F.col("applyUrl")),
        job_posted_at_datetime_utc=F.col("publishedAt"),
        job_location=place,
        job_is_remote=F.coalesce("isRemote", F.lit(False)) | F.lower(place).contains("remote"),
        job_employment_types=employment_type(kind, ASHBY_TYPES),
        job_description=F.coalesce(F.nullif("descriptionPlain", F.lit("")), X.html_to_text(F.col("descriptionHtml"))),
    )


def greenhouse(df: DataFrame, company: Column) -> DataFrame:
    """df: rows of schemas.GREENHOUSE. There are no employment types."""
    jobs = df.select(F.explode("jobs").alias("j")).select("j.*")
    place = F.coalesce("location.name", F.lit(""))
    return _raw(
        jobs,
        job_id=F.concat(F.lit("greenhouse-"), F.col("id")),
        job_title=F.coalesce(F.nullif("title", F.lit("")), F.lit("N/A")),
        employer_name=F.coalesce(F.nullif("company_name", F.lit("")), company),
        job_apply_link=F.coalesce("absolute_url", F.lit("")),
        job_posted_at_datetime_utc=F.coalesce(F.nullif("first_published", F.lit("")), F.col("updated_at")),
        job_location=place,
        job_is_remote=F.lower(place).contains("remote"),
        job_employment_types=F.array().cast("array<string>"),
        job_description=X.html_to_text(F.col("content")),
    )


KINDS = {"lever": (lever, schemas.LEVER), "ashby": (ashby, schemas.ASHBY), "greenhouse": (greenhouse, schemas.GREENHOUSE)}


def read(spark: SparkSession, kind: str, path: str, board: str) -> DataFrame:
    """Canonical raw postings of a board's recorded JSON."""
    shape, schema = KINDS[kind]
    return shape(spark.read.schema(schema).option("multiLine", True).json(path), board_name(F.lit(board), kind))


def wanted(raw: DataFrame, known: DataFrame) -> DataFrame:
    """New postings with a fitting title."""
    return raw.join(known.select(F.col("source_job_id").alias("job_id")).distinct(), "job_id", "left_anti").where(is_cs_title(F.col("job_title")))
