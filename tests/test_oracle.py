"""Every query of the engine against its SQL, on whole tables; those without SQL give rows with a stable schema."""

import math
import os

import duckdb
import pytest
from webloom.plans import registry

TOP = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{TOP}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def lines(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, TOP)
    want = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = lines(map(tuple, df.select(*names).collect()))
    want = lines(want.select(*(f'"{n}"' for n in names)).fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows_only(spark, name):
    df = registry.queries()[name](spark, TOP)
    assert df.columns and df.schema == registry.queries()[name](spark, TOP).schema
    df.count()
