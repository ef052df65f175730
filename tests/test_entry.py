import duckdb
import pytest

from conftest import SF_SMALL
import __spark_entry__ as E
from tools.check_oracles import TABLES, rows_of

from setscope.plans.catalog import QUERIES
from setscope.plans.oracles import ORACLES

SQL_CHECKED = sorted(ORACLES)


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["item", "freq", "item_description"]
    assert df.count() > 0 and [t for _, t in df.dtypes] == ["string", "int", "string"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_query_matches_sql_twin(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    # the SQL must also stand as a view
    duck.execute(f"CREATE OR REPLACE VIEW twin AS {ORACLES[name]}")
    res = duck.execute("SELECT * FROM twin")
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, res.fetchall())
