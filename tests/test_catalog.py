"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tests.conftest import tables_dir
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tables_dir()}/{t}.parquet'")
    return c


def rows(df, columns):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in df[columns].itertuples(index=False, name=None)), key=repr)


def test_all_have_twins():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_twin(spark, duck, name):
    got = catalog.QUERIES[name](spark, tables_dir()).toPandas()
    expected = duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "language", "origin_query", "item_title", "label"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
