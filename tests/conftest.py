import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tallygrove.session import local_session

    session = local_session(8, 8, "6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def plain(value):
    """Values of either engine in one form: floats to 9 digits, rows and lists to tuples."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def same(spark, data):
    """Compares a query with its SQL over the same tables."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        got = sorted((repr([plain(r[c]) for c in names]) for r in df.collect()))
        expected = con.sql(sql)
        assert sorted(expected.columns) == names
        at = [expected.columns.index(c) for c in names]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in expected.fetchall())

    return check
