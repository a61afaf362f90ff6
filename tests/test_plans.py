import duckdb
import pandas as pd
import pytest

from quarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(df, columns):
    plain = lambda x: None if pd.isna(x) else round(float(x), 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_plan_equals_sql(spark, sf, oracle, name):
    got, want = catalogue.queries()[name](spark, sf).toPandas(), oracle.execute(catalogue.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_plan_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
