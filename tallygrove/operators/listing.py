"""The faceted listing: optional predicates, two orders, paging, an exact count."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_MAX = 300_000
DAYS = {"24h": 1, "7d": 7, "30d": 30}


@dataclass(frozen=True)
class Filters:
    search: str = ""
    skills: tuple[str, ...] = ()
    visa_only: bool = False
    salary_min: float = 0
    salary_max: float = NO_MAX
    work_modes: tuple[str, ...] = ()
    experience_levels: tuple[str, ...] = ()
    date_posted: str = "any"
    seasons: tuple[str, ...] = ()
    now: dt.datetime | None = field(default=None, compare=False)

    def key(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "now"}


def search(text: str) -> Column:
    """Wildcards in the text are not escaped, so % and _ act as such."""
    like = f"%{text.strip().lower()}%"
    return F.lower("title").like(like) | F.lower("company").like(like)


def has_skill(skill: str) -> Column:
    """A substring of the joined array; array_join, since a null array must stay null and so not match."""
    return F.array_join("required_skills", ",").ilike(f"%{skill.lower()}%")


def min_salary(least: float) -> Column:
    return F.col("salary_min").isNotNull() & (F.col("salary_min") >= least)


def max_salary(most: float) -> Column:
    """Unlike the minimum, an unknown maximum passes."""
    return F.col("salary_max").isNull() | (F.col("salary_max") <= most)


def posted_within(period: str, now: dt.datetime) -> Column:
    """A period that isn't known means 30 days."""
    return F.col("posted_at") >= F.lit(now - dt.timedelta(days=DAYS.get(period, 30)))


def season(names) -> Column:
    return reduce(lambda a, b: a | b, (F.lower("start_date_text").like(f"%{n.lower()}%") for n in names))


def not_synthetic() -> Column:
    return ~F.col("source_job_id").like("synthetic-%")


def predicates(f: Filters) -> list[Column]:
    """One for each filter that isn't at its default; the default emits nothing."""
    out = []
    if f.search.strip():
        out.append(search(f.search))
    out += [has_skill(s) for s in f.skills]
    if f.visa_only:
        out.append(F.col("visa_sponsorship"))
    if f.salary_min > 0:
        out.append(min_salary(f.salary_min))
    if f.salary_max < NO_MAX:
        out.append(max_salary(f.salary_max))
    if f.work_modes:
        out.append(F.col("work_mode").isin(*f.work_modes))
    if f.experience_levels:
        out.append(F.col("experience_level").isin(*f.experience_levels))
    if f.date_posted != "any":
        out.append(posted_within(f.date_posted, f.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)))
    if f.seasons:
        out.append(season(f.seasons))
    return out


def filtered(listings: DataFrame, f: Filters) -> DataFrame:
    return reduce(DataFrame.where, predicates(f), listings)


def ordered(listings: DataFrame, sort: str = "newest") -> DataFrame:
    """Every name but `salary` means newest first; the id breaks all ties."""
    keys = ("salary_max", "salary_min") if sort == "salary" else ("posted_at",)
    return listings.orderBy(*[F.col(k).desc_nulls_last() for k in keys], F.col("id").desc())


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page from 1, page_size from 1 to 100")


def page_of(listings: DataFrame, f: Filters, sort: str = "newest", page: int = 1, page_size: int = 20) -> DataFrame:
    """One TakeOrderedAndProject: offset and limit are part of the top k."""
    check_page(page, page_size)
    return ordered(filtered(listings, f), sort).offset((page - 1) * page_size).limit(page_size)


def totals(listings: DataFrame, f: Filters, page_size: int = 20) -> DataFrame:
    """`total` and `total_pages`, which is 1 for nothing."""
    counted = filtered(listings, f).agg(F.count(F.lit(1)).alias("total"))
    return counted.withColumn("total_pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / page_size).cast("long")))


SHORT = (
    "id source_job_id title company source url posted_at expires_at scraped_at city state country is_remote work_mode job_type experience_level salary_min salary_max "
    "salary_currency salary_period required_skills visa_sponsorship start_date_text"
).split()
LONG = ["description", "responsibilities", "qualifications", "benefits"]


def shaped(listings: DataFrame, full: bool = False) -> DataFrame:
    """The list projection, or with full the one of a single posting; null skills become empty, times ISO texts."""
    out = []
    for name in SHORT + LONG * full:
        kind = listings.schema[name].dataType.simpleString() if name in listings.columns else None
        if kind is None:
            continue
        c = F.col(name)
        if name == "required_skills":
            c = F.coalesce(c, F.array().cast("array<string>"))
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(name))
    return listings.select(*out)


def by_id(listings: DataFrame, id: int) -> DataFrame:
    return listings.where(F.col("id") == id)


def picker(listings: DataFrame, query: str, newest: int = 60, k: int = 12) -> DataFrame:
    """Of the newest postings the first k whose title and company hold the query, case aside; its signs are literal."""
    some = ordered(listings).limit(newest)
    held = F.lower(F.concat_ws(" ", "title", "company")).contains(query.lower())
    return ordered(some.where(held)).limit(k)
