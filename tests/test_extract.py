import pytest
from pyspark.sql import functions as F

from tallygrove.functions import extract as X
from tallygrove.functions import text as T


def run(spark, make, *values):
    """The column that make() builds over c0, c1, ... for one row of values."""
    names = [f"c{i}" for i in range(len(values))]
    kinds = {str: "string", bool: "boolean", list: "array<string>", type(None): "string", int: "int"}
    df = spark.createDataFrame([values], ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, values)))
    found = df.select(make(*[F.col(n) for n in names]).alias("x")).first().x
    return found.asDict() if hasattr(found, "asDict") else found


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("$76,500 – $125,000 a year", (76500.0, 125000.0, "YEAR")),
        ("$76.5K to $125k", (76500.0, 125000.0, "YEAR")),
        ("80K - 120K per month", (80000.0, 120000.0, "MONTH")),
        ("$10,000 - $12,000", (10000.0, 12000.0, "HOUR")),
        ("$120,000+", (120000.0, None, "YEAR")),
        ("about 95K", (95000.0, None, "YEAR")),
        ("5 years, $40 per hour", None),
        ("costs $, or so", None),
        ("", None),
    ],
)
def test_salary(spark, text, expected):
    found = run(spark, X.salary, text)
    assert (found and (found["min"], found["max"], found["period"])) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Engineer in Beavercreek, OH", ("Beavercreek", "OH")), ("Engineer – Phoenix AZ", ("Phoenix", "AZ")), ("Ann Arbor, MI office", ("Ann Arbor", "MI")), ("in Paris, ZZ", None)],
)
def test_city_state(spark, text, expected):
    found = run(spark, X.city_state, text)
    assert (found and (found["city"], found["state"])) == expected


def test_location_cascade(spark):
    def of(*values):
        return tuple(run(spark, X.location, *values).values())

    assert of(None, "TX", None, "Boston, MA", "", "") == (None, "TX", None)
    assert of(None, None, None, "Boston, MA, US", "", "") == ("Boston", "MA", None)
    assert of(None, None, None, "Remote", "Dev in Austin, TX", "") == ("Austin", "TX", "US")
    # The labelled pattern ignores case, so its shortest match can end within the city.
    assert of("", None, None, None, "Dev", "Location: Austin, TX") == ("Aust", "IN", "US")
    assert of(None, None, None, "anywhere", "Dev", "nothing") == (None, None, None)


@pytest.mark.parametrize(
    ("title", "level", "kind"),
    [("Software Engineering Intern", "intern", "INTERN"), ("Co-op, data", "intern", "INTERN"), ("Sr. Engineer", "senior", "FULLTIME"), ("New Grad Engineer", "entry", "FULLTIME"), ("International Engineer", "mid", "FULLTIME")],
)
def test_level_and_type(spark, title, level, kind):
    assert run(spark, X.experience_level, title) == level
    assert run(spark, X.job_type, title) == kind


def test_flags_go_before_titles(spark):
    assert run(spark, X.experience_level, "Senior Engineer", ["INTERN"]) == "intern"
    assert run(spark, X.job_type, "Engineer", ["CONTRACTOR"]) == "CONTRACT"
    assert run(spark, X.type_from_title, "Engineer", "PARTTIME") == "PARTTIME"
    assert run(spark, X.type_from_title, "Engineer", "INTERN") == "FULLTIME"


def test_skills(spark):
    assert run(spark, X.skills, "We use C++, R, PostgreSQL and Node.js; CI/CD too.") == ["r", "node.js", "ci/cd", "postgresql"]
    assert run(spark, X.skills, "javascript") == ["javascript"]
    assert run(spark, X.skills, "c++x") == ["c++"]
    assert run(spark, X.skills, None) == []


@pytest.mark.parametrize(
    ("title", "text", "expected"),
    [("Intern Summer of 2026", "", "Summer 2026"), ("Autumn 2025", "", "Fall 2025"), ("2026 spring", "", "Spring 2026"), ("Summer/Fall 2026", "", "Fall 2026"), ("Dev", "starts June 2027", "June 2027"), ("Winter Cohort", "", "Winter"), ("Dev", "", None)],
)
def test_start_date(spark, title, text, expected):
    assert run(spark, X.start_date, title, text) == expected


@pytest.mark.parametrize(
    ("remote", "text", "expected"),
    [(False, "100 % remote, hybrid role", "remote"), (True, "must work on-site", "onsite"), (True, "hybrid schedule; 3 days in the office", "hybrid"), (False, "hybrid cloud", "onsite"), (True, "", "remote"), (False, "a remote village", "remote")],
)
def test_work_mode(spark, remote, text, expected):
    assert run(spark, X.work_mode, remote, text) == expected


@pytest.mark.parametrize(("text", "expected"), [("We sponsor. No visa.", False), ("H1B sponsor", True), ("not eligible for visa sponsorship", True), ("nothing", None), (None, None)])
def test_visa(spark, text, expected):
    assert run(spark, X.visa, text) is expected


def test_sections(spark):
    text = "Intro\nWhat you'll do:\n- build large systems\n- ship\nPlain line that is long enough to count\nRequirements\nFive or more programming languages known\nBenefits:\n1. free lunch every day\nPerks\n* a gym membership"
    found = run(spark, X.sections, text)
    assert found["responsibilities"] == ["build large systems"]
    assert found["qualifications"] == ["Five or more programming languages known"]
    assert found["benefits"] == ["free lunch every day", "a gym membership"]


def test_html(spark):
    html = "<p>A &amp; B</p><ul><li>one<li class=x>two</ul>C<br/>D<script>x()</script>&lt;p&gt;E&lt;/p&gt;"
    assert run(spark, T.html_to_text, html) == "A & B\n\n- one\n- twoC\nDx()E"


def test_citations(spark):
    assert run(spark, T.cited, "a [2], b [1, 3] [2] [x]") == [2, 1, 3]
    assert run(spark, T.abstains, " insufficient. ") is True
    assert run(spark, T.rescued_json, 'So: {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert run(spark, T.rescued_json, "no json") is None


def test_small(spark):
    assert run(spark, X.domain, "https://A.Example.co.uk/x") == "co.uk"
    assert run(spark, X.domain, "nonsense") == ""
    assert run(spark, X.client_ip, " 1.2.3.4 , 5.6.7.8", "p") == "1.2.3.4"
    assert run(spark, X.client_ip, None, None) == "unknown"
