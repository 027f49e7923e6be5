"""Every query with SQL against that SQL, and the entry contract."""

import math

import duckdb
import pytest

import __spark_entry__
from tidebook.plans import all_plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(all_plans.ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = all_plans.QUERIES[name](spark, sf_dir)
    got = con.execute(all_plans.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(got.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
