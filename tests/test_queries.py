"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from ledgerloom.plans import audits, inventory, lookups, proxies, trees

ALL = proxies.QUERIES | inventory.QUERIES | lookups.QUERIES | trees.QUERIES | audits.QUERIES
SQL = proxies.ORACLES | inventory.ORACLES | lookups.ORACLES | trees.ORACLES | audits.ORACLES
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ALL))
def test_equals_sql(spark, duck, name):
    got = ALL[name](spark, SF)
    names = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*names).collect()]
    found = duck.execute(SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    want = [tuple(plain(r[at.index(n)]) for n in names) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(proxies.QUERIES) <= set(__spark_entry__.queries()) and set(proxies.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    plan = proxies.QUERIES["asof_decision"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in plan and "props" not in plan.split("== Physical Plan ==")[1]
