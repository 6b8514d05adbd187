"""HTML, paragraphs, citations, JSON rescue and prompt contexts, as column expressions where the built-ins reach."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities have no built-in: a table of over two thousand names with prefix rules."""
    return texts.map(lambda t: None if t is None else _html.unescape(t))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tags_to_text(c: Column) -> Column:
    """Tags to line breaks and bullets; bodies of scripts and styles stay as text."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<li[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6])>", "\n\n")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(c)


def html_to_text(c: Column) -> Column:
    return tags_to_text(unescape(c))


def clean(c: Column) -> Column:
    c = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"(?U)\n\s*\n\s*", "\n\n"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != ""))


def paragraphs(c: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(clean(c), separator, -1), strip), lambda p: p != "")


def paragraph_key(p: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(p, r"[^\p{L}\p{N}_]+", " ")))


def is_heading(p: Column) -> Column:
    bare = strip(F.regexp_replace(p, ":+$", ""))
    bullet = p.rlike(r"^\s*(?:[-*•·◦▪]|\d+[.)])\s*")
    return ~p.contains("\n") & ~bullet & word_count(bare).between(1, 8) & ~bare.rlike(r"[.!?,;]$")


def is_boilerplate(p: Column) -> Column:
    return p.rlike("(?i)" + P.BOILERPLATE)


# --- citations ------------------------------------------------------------------



def normal_citations(answer: Column) -> Column:
    """Citations in lenticular or full-width brackets as [n, m], without what follows the numbers there."""
    c = F.regexp_replace(answer, "(?U)" + P.FOREIGN_CITED, "[$1]")
    return F.regexp_replace(c, "(?U)" + P.WIDE_COMMA_CITED, ", ")


def cited(answer: Column) -> Column:
    """Cited numbers in order of first appearance."""
    found = F.regexp_extract_all(answer, F.lit("(?U)" + P.CITED), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(found, lambda g: F.split(g, ","))), lambda n: F.regexp_replace(n, r"(?U)\s+", "").try_cast("int"))
    return F.array_distinct(numbers)


def abstains(answer: Column, token: str = P.ABSTAIN) -> Column:
    return F.upper(F.regexp_replace(strip(answer), r"^\.+|\.+$", "")) == token


def out_of_range(numbers: Column, n: Column) -> Column:
    return F.filter(numbers, lambda x: (x < 1) | (x > n))


def problem(answer: Column, n: Column) -> Column:
    """What is wrong with an answer over n sources, else null."""
    numbers = cited(answer)
    return (
        F.when(strip(F.coalesce(answer, F.lit(""))) == "", "empty")
        .when(F.size(numbers) == 0, "uncited")
        .when(F.size(out_of_range(numbers, n)) > 0, F.concat(F.lit("out of range: "), F.array_join(out_of_range(numbers, n).cast("array<string>"), ", ")))
    )


def answer_status(answer: Column, n: Column, error: Column) -> Column:
    return (
        F.when(error.isNotNull(), "error").when(n == 0, "no_results").when(abstains(answer), "abstained").when(problem(answer, n).isNotNull(), "ungrounded").otherwise("answered")
    )


@dataclass(frozen=True)
class Reading:
    """One answer as the columns above read it: its text with plain citations, the numbers cited, and those without a source."""

    text: str
    numbers: tuple[int, ...]
    outside: tuple[int, ...]
    abstains: bool

    @property
    def inside(self) -> list[int]:
        return [n for n in self.numbers if n not in self.outside]

    @property
    def problem(self) -> str | None:
        if self.abstains:
            return None
        if not self.text.strip():
            return "empty"
        if not self.numbers:
            return "uncited"
        return "out of range: " + ", ".join(map(str, self.outside)) if self.outside else None


def read_answer(answer: str, n: int) -> Reading:
    """An answer over n sources."""
    plain = re.sub(P.WIDE_COMMA_CITED, ", ", re.sub(P.FOREIGN_CITED, r"[\1]", answer))
    numbers = tuple(dict.fromkeys(map(int, re.findall(r"\d+", " ".join(re.findall(P.CITED, plain))))))
    return Reading(plain, numbers, tuple(x for x in numbers if not 1 <= x <= n), plain.strip().strip(".").upper() == P.ABSTAIN)


# Fixed value: how a source is shown to a model.
SOURCE_FORM = "[%d] %s at %s — %s\n%s"
# End of fixed values.
SOURCE_FIELDS = ("title", "company", "section", "body")


def source_block(sources: Column) -> Column:
    """'[1] title at company, section' and the body, for each source; one that lacks a field is left out."""

    def shown(s, i):
        fields = [s[name] for name in SOURCE_FIELDS]
        known = fields[0].isNotNull()
        for f in fields[1:]:
            known = known & f.isNotNull()
        return F.when(known, F.format_string(SOURCE_FORM, i + 1, *fields))

    return F.array_join(F.transform(sources, shown), "\n\n")


def numbered_sources(sources: Column, numbers: Column) -> Column:
    """Each source as (n, source, cited), counted from 1."""
    return F.transform(sources, lambda s, i: F.struct((i + 1).alias("n"), s.alias("source"), F.coalesce(F.array_contains(numbers, i + 1), F.lit(False)).alias("cited")))


def cited_first(numbered: Column) -> Column:
    """Numbered sources with the cited ones before the others, each in their order."""
    return F.concat(F.filter(numbered, lambda s: s["cited"]), F.filter(numbered, lambda s: ~s["cited"]))


# --- JSON and prompts --------------------------------------------------------------


def rescued_json(text: Column) -> Column:
    """The JSON object in a model's reply as text: as it stands, without code fences, or from first to last brace."""

    def valid(c):
        return F.when(F.try_parse_json(c).isNotNull() & c.isNotNull(), c)

    fenced = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(valid(F.trim(text)), valid(fenced), F.when(block != "", valid(block)))


def _money(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != 0), F.concat(F.lit("$"), F.format_number(c.cast("bigint"), 0))).otherwise("?")


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def _some_salary(low: Column, high: Column) -> Column:
    return (F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0)


def profile_text(r) -> Column:
    """A posting's structured facts in a sentence or two; r gives its columns by name."""
    period = F.lower(F.coalesce(F.nullif(r("salary_period"), F.lit("")), F.lit("year")))
    labelled = [F.concat(F.lit(f"{label}: "), F.nullif(r(name), F.lit(""))) for label, name in (("Level", "experience_level"), ("Type", "job_type"), ("Work mode", "work_mode"))]
    facts = F.concat_ws(
        ". ",
        *labelled,
        F.concat(F.lit("Location: "), _joined(r("city"), r("state"), r("country"))),
        F.when(_some_salary(r("salary_min"), r("salary_max")), F.concat(F.lit("Salary: "), _money(r("salary_min")), F.lit("–"), _money(r("salary_max")), F.lit(" per "), period)),
        F.when(r("visa_sponsorship"), "Visa sponsorship: yes").when(~r("visa_sponsorship"), "Visa sponsorship: no"),
        F.concat(F.lit("Start: "), F.nullif(r("start_date_text"), F.lit(""))),
    )
    known = F.when(F.size(r("required_skills")) > 0, F.concat(F.lit("Skills: "), F.array_join(F.slice(r("required_skills"), 1, 25), ", "), F.lit(".")))
    return F.concat_ws(" ", F.concat(r("title"), F.lit(" at "), r("company"), F.lit(".")), F.when(facts != "", F.concat(facts, F.lit("."))), known)


def job_context(r) -> Column:
    """A posting for a model's prompt: labelled lines, 12 skills, 3000 characters of description."""

    def or_else(name, default):
        return F.coalesce(F.nullif(r(name), F.lit("")), F.lit(default))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Job Title: "), r("title")),
        F.concat(F.lit("Company: "), r("company")),
        F.concat(F.lit("Work Mode: "), or_else("work_mode", "remote")),
        F.concat(F.lit("Experience Level: "), or_else("experience_level", "not specified")),
        F.concat(F.lit("Job Type: "), or_else("job_type", "Full-time")),
        F.when(_some_salary(r("salary_min"), r("salary_max")), F.concat(F.lit("Salary: "), _money(r("salary_min")), F.lit(" – "), _money(r("salary_max")), F.lit(" / "), or_else("salary_period", "yr"))),
        F.when(r("visa_sponsorship"), "Visa Sponsorship: Yes").when(~r("visa_sponsorship"), "Visa Sponsorship: No"),
        F.when(F.size(r("required_skills")) > 0, F.concat(F.lit("Key Skills: "), F.array_join(F.slice(r("required_skills"), 1, 12), ", "))),
        F.concat(F.lit("Location: "), _joined(r("city"), r("state"))),
        F.concat(F.lit("\nFull Job Description:\n"), F.left(F.coalesce(r("description"), F.lit("")), F.lit(3000))),
    )
