"""Fields from free text, as column expressions: location, salary, sections, skills, level, type, start, mode, visa."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _any_substring(c: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(c, F.lit(p)), F.lit(False)) for p in phrases))


def is_cs_title(title: Column) -> Column:
    return _any_substring(F.lower(title), P.CS_KEYWORDS)


# --- location ---------------------------------------------------------------

_PLACE = r"([A-Z][a-zA-Z\s\-]+?),?\s+([A-Z]{2})\b"
PLACE_PATTERNS = (rf"(?U)\bin\s+{_PLACE}", rf"(?U)[-–]\s*{_PLACE}", r"(?U)\b([A-Z][a-zA-Z\s\-]{2,30}),\s*([A-Z]{2})\b")
LABELLED_PLACE = r"(?iU)location\s*[:\-]\s*([A-Z][a-zA-Z\s\-]+?),?\s*([A-Z]{2})\b"


def _place(text: Column, pattern: str, upper: bool = False) -> Column:
    state = F.regexp_extract(text, pattern, 2)
    state = F.upper(state) if upper else state
    return F.when(state.isin(P.US_STATES), F.struct(F.trim(F.regexp_extract(text, pattern, 1)).alias("city"), state.alias("state")))


def city_state(text: Column) -> Column:
    """struct<city, state> from the first pattern whose first match names a state, else null."""
    return F.coalesce(*[_place(text, p) for p in PLACE_PATTERNS])


def location(city: Column, state: Column, country: Column, place: Column, title: Column, description: Column) -> Column:
    """struct<city, state, country>: given fields, else the place text, else the title, else the description's beginning."""
    kind = "struct<city:string,state:string,country:string>"

    def of(a, b, c):
        return F.struct(a.alias("city"), b.alias("state"), c.alias("country")).cast(kind)

    null = F.lit(None).cast("string")
    given = [_nonempty(F.coalesce(c, F.lit(""))) for c in (city, state, country)]
    trimmed = F.trim(F.coalesce(place, F.lit("")))
    parts = F.transform(F.split(trimmed, ",", -1), lambda x: F.trim(x))
    head = F.substring(F.coalesce(description, F.lit("")), 1, 600)
    found = F.coalesce(city_state(F.coalesce(title, F.lit(""))), _place(head, LABELLED_PLACE, upper=True), city_state(head))
    return F.coalesce(
        F.when(reduce(lambda a, b: a | b, (g.isNotNull() for g in given)), of(city, state, country)),
        F.when(~F.lower(trimmed).isin("", "anywhere", "remote"), of(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), null)),
        F.when(found.isNotNull(), of(found["city"], found["state"], F.lit("US"))),
        of(null, null, null),
    )



# --- salary -----------------------------------------------------------------

LOW, HIGH = 10_000, 1_000_000
DOLLAR_RANGE = r"\$\s*([\d,]+(?:\.\d+)?)\s*([Kk])?\s*[-–to]+\s*\$?\s*([\d,]+(?:\.\d+)?)\s*([Kk])?"
K_RANGE = r"(?i)([\d]+(?:\.\d+)?)\s*[Kk]\s*[-–to]+\s*([\d]+(?:\.\d+)?)\s*[Kk]"
DOLLAR_ONE = r"\$\s*([\d,]+(?:\.\d+)?)\s*([Kk])?\+?"
K_ONE = r"(?i)\b([\d]+(?:\.\d+)?)\s*[Kk]\+?"


def _amount(text: Column, pattern: str, group: int, k_group: int | None) -> Column:
    """Null without a match, or where only commas were captured."""
    value = F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit("")).try_cast("double")
    if k_group is None:
        return value * 1000
    return F.when((F.regexp_extract(text, pattern, k_group) != "") & (value < 1000), value * 1000).otherwise(value)


def salary_period(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(_any_substring(t, ("year", "annual", "/yr")), "YEAR")
        .when(_any_substring(t, ("hour", "/hr", "/h ")), "HOUR")
        .when(_any_substring(t, ("month", "/mo")), "MONTH")
    )


def salary(text: Column) -> Column:
    """struct<min, max, period> or null: a dollar range, a K range, one dollar amount, one K amount, within bounds."""
    period = salary_period(text)

    def of(low, high, default):
        return F.struct(low.alias("min"), high.cast("double").alias("max"), F.coalesce(period, default).alias("period"))

    year, none = F.lit("YEAR"), F.lit(None)
    a, b = _amount(text, DOLLAR_RANGE, 1, 2), _amount(text, DOLLAR_RANGE, 3, 4)
    c, d = _amount(text, K_RANGE, 1, None), _amount(text, K_RANGE, 2, None)
    one, k = _amount(text, DOLLAR_ONE, 1, 2), _amount(text, K_ONE, 1, None)
    return F.coalesce(
        F.when(a.between(LOW, HIGH) & (a <= b) & (b <= HIGH), of(a, b, F.when(a > LOW, "YEAR").otherwise("HOUR"))),
        F.when((c >= LOW) & (c <= d) & (d <= HIGH), of(c, d, year)),
        F.when(one.between(LOW, HIGH), of(one, none, year)),
        F.when(k.between(LOW, HIGH), of(k, none, year)),
    )


def chosen_salary(low: Column, high: Column, period: Column, text: Column, description: Column) -> Column:
    """The structured fields if there is a minimum; else what the salary text, or the description's beginning, says."""
    said = salary(F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.substring(F.coalesce(description, F.lit("")), 1, 800)))
    given = F.struct(low.cast("double").alias("min"), high.cast("double").alias("max"), period.alias("period"))
    return F.when(low.isNull() & said.isNotNull(), said).otherwise(given)


# --- sections ---------------------------------------------------------------

BULLET = r"^[•\-–*·▪▸►]\s+(.+)"
NUMBERED = r"^\d+[.)]\s+(.+)"


def section_of(line: Column) -> Column:
    """The section that a line is a header of, else null."""
    stripped = F.trim(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    clean = F.regexp_replace(F.regexp_replace(F.lower(stripped), r"(?U)[:\-–•*\s]+$", ""), r"^\d+%\s+", "")
    chain = F.when((stripped == "") | stripped.rlike(r"[.!?]$"), F.lit(None).cast("string"))
    for name, alternatives in P.SECTIONS.items():
        chain = chain.when(clean.rlike("|".join(alternatives)), name)
    return chain


def items(lines: Column) -> Column:
    """Bulleted or numbered texts of over 10 characters; if there are none, plain lines of 20 to 350 not ending in a colon."""
    stripped = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))

    def marked(x):
        return F.trim(F.when(x.rlike(BULLET), F.regexp_extract(x, BULLET, 1)).otherwise(F.regexp_extract(x, NUMBERED, 1)))

    bullets = F.filter(F.transform(stripped, marked), lambda x: F.length(x) > 10)
    plain = F.filter(stripped, lambda x: ~x.rlike(BULLET) & ~x.rlike(NUMBERED) & F.length(x).between(20, 350) & ~x.endswith(":"))
    return F.when(F.size(bullets) > 0, bullets).otherwise(plain)


def sections(description: Column) -> Column:
    """struct of arrays: the items under each kind of header; blocks of one kind follow one another."""
    block = "struct<section:string,lines:array<string>>"
    zero = F.struct(F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("lines"), F.array().cast(f"array<{block}>").alias("blocks"))
    lines = F.transform(F.split(F.coalesce(description, F.lit("")), "\n", -1), lambda x: F.struct(x.alias("line"), section_of(x).alias("section")))

    def closed(acc):
        last = F.array(F.struct(acc["section"].alias("section"), acc["lines"].alias("lines")))
        return F.when(acc["section"].isNull(), acc["blocks"]).otherwise(F.concat(acc["blocks"], last))

    def step(acc, x):
        opened = F.struct(x["section"].alias("section"), F.array().cast("array<string>").alias("lines"), closed(acc).alias("blocks"))
        same = F.struct(acc["section"].alias("section"), F.concat(acc["lines"], F.array(x["line"])).alias("lines"), acc["blocks"].alias("blocks"))
        return F.when(x["section"].isNotNull(), opened).otherwise(same)

    blocks = F.aggregate(lines, zero, step, closed)
    return F.struct(*[F.flatten(F.transform(F.filter(blocks, _named(name)), lambda b: items(b["lines"]))).alias(name) for name in P.SECTIONS])


def _named(name: str):
    return lambda b: b["section"] == name


# --- flags and categories ----------------------------------------------------


def skills(description: Column) -> Column:
    """The dictionary's skills that the text names, in dictionary order."""
    t = F.lower(F.coalesce(description, F.lit("")))
    # Skills of letters and digits are words of the text, which is cut once for all of them; only the others need patterns, and
    # a plain search, far cheaper, goes ahead of these.
    plain = [s for s in P.SKILLS if s.isalnum()]
    words = F.array_intersect(F.array(*map(F.lit, plain)), F.split(t, r"[^\p{L}\p{N}_]+", -1))
    marked = [F.when(F.contains(t, F.lit(s)) & t.rlike(P.skill_pattern(s)), F.lit(s)) for s in P.SKILLS if s not in plain]
    return F.array_intersect(F.array(*map(F.lit, P.SKILLS)), F.concat(words, F.array_compact(F.array(*marked))))


def _flag(types: Column | None, name: str) -> Column:
    return F.lit(False) if types is None else F.coalesce(F.array_contains(types, name), F.lit(False))


def _word(title: Column, alternatives: str) -> Column:
    return _has(F.lower(title), P.whole_words(alternatives))


def experience_level(title: Column, types: Column | None = None) -> Column:
    return F.when(_flag(types, "INTERN") | _word(title, P.INTERN), "intern").when(_word(title, P.SENIOR), "senior").when(_word(title, P.ENTRY), "entry").otherwise("mid")


def job_type(title: Column, types: Column | None = None) -> Column:
    return F.when(_flag(types, "INTERN") | _word(title, P.INTERN), "INTERN").when(_flag(types, "CONTRACTOR"), "CONTRACT").when(_flag(types, "PARTTIME"), "PARTTIME").otherwise("FULLTIME")


def type_from_title(title: Column, old: Column) -> Column:
    """On a reparse the feed's flags are gone: contract and part time are kept, all else comes from the title."""
    return F.when(_word(title, P.INTERN), "INTERN").when(old.isin("CONTRACT", "PARTTIME"), old).otherwise("FULLTIME")


def start_date(title: Column, description: Column) -> Column:
    """'Season YYYY', 'Month YYYY' or a bare season, from the title and the description's beginning."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, 800))
    any_season = f"{P.SEASONS}|autumn"

    def found(pattern, name, year):
        said = F.lower(F.regexp_extract(text, pattern, name))
        label = F.when(said == "autumn", "Fall").otherwise(F.initcap(said))
        return F.when(said != "", F.concat(label, F.lit(" "), F.regexp_extract(text, pattern, year)) if year else label)

    e, a = P.EDGE_BEFORE, P.EDGE_AFTER
    return F.coalesce(
        found(rf"(?i){e}({any_season})\s+(?:of\s+)?(20\d\d){a}", 1, 2),
        found(rf"(?i){e}(20\d\d)\s+({any_season}){a}", 2, 1),
        found(rf"(?i){e}({P.MONTHS})\s+(20\d\d){a}", 1, 2),
        found(rf"(?i){e}({P.SEASONS})\s+(?:{P.SEASON_NOUNS}){a}", 1, None),
    )


def work_mode(is_remote: Column, description: Column) -> Column:
    d = F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(d.rlike(P.REMOTE), "remote")
        .when(d.rlike("|".join(P.ONSITE)), "onsite")
        .when(d.rlike("|".join(P.HYBRID)), "hybrid")
        .when(F.coalesce(is_remote, F.lit(False)) | F.contains(d, F.lit("remote")), "remote")
        .otherwise("onsite")
    )


def visa(description: Column) -> Column:
    """False, true or unknown (null)."""
    d = F.lower(description)
    return F.when(_any_substring(d, P.VISA_NO), False).when(_any_substring(d, P.VISA_YES), True)


# --- small ones ----------------------------------------------------------------


def domain(url: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"\.", -1)
    return F.array_join(F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts), ".")


def employment_type(value: Column, types: dict[str, str]) -> Column:
    """A feed's employment type by its table, as an array of at most one."""
    table = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    found = F.try_element_at(table, F.lower(F.coalesce(value, F.lit(""))))
    return F.when(found.isNull(), F.array().cast("array<string>")).otherwise(F.array(found))


def client_ip(forwarded: Column, peer: Column) -> Column:
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(_nonempty(first), peer, F.lit("unknown"))


def relative_time(at: Column, now: Column) -> Column:
    minutes = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 60
    days = F.floor(minutes / 1440)
    return (
        F.when(at.isNull(), "")
        .when(minutes < 60, F.concat(F.greatest(F.lit(0), F.floor(minutes)).cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "strong").when(score >= 50, "moderate").otherwise("weak")
