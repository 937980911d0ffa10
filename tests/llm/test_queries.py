"""The registered queries against their SQL twins in DuckDB."""

import duckdb
import pytest

from tessera.llm import queries
from tests.conftest import tables_dir
from tests.test_catalog import TABLES, rows


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tables_dir()}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, duck, name):
    got = queries.QUERIES[name](spark, tables_dir()).toPandas()
    expected = duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)
