"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.oracle_sql() if not k.startswith("op"))

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(df):
    one = lambda v: "-" if v is None or v != v else repr(round(float(v), 8) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, D).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["repeat", "fold", "delta_auroc", "rwr_auroc", "degree_auroc"]
