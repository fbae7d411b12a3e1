"""Every query runs, and equals its DuckDB twin, over the smallest tables."""

import os

import duckdb
import pytest

from quarrylight.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(value):
    if isinstance(value, float):
        return round(value, 5)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([comparable(r[k]) for k in order] for r in records), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if sql := registry.oracle_sql().get(name):
        cursor = db.execute(sql)
        assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_comparison_sees_a_difference():
    assert rows(["a"], [(1,)]) != rows(["a"], [(2,)])
