import duckdb
import pytest

from veclode.queries import QUERIES, SQL

TABLES = "customer documents embeddings events lineitem nation orders part region supplier".split()


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 250
    assert set(entry.oracle_sql()) <= set(entry.queries())
