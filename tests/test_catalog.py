"""Every query of the library itself against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    told = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(told.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    wanted = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {names} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=repr)
    assert found == wanted


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["src", "dst", "weight"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
