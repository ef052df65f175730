import pytest

from conftest import SF_SMALL
from setscope.plans.catalog import QUERIES
from setscope.plans.oracles import ORACLES
from tools.check_oracles import rows_of

SQL_CHECKED = sorted(ORACLES)


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_same_result_with_other_shuffle_partitions(spark, name):
    fn = QUERIES[name]
    a = fn(spark, SF_SMALL)
    first = rows_of(a.columns, [tuple(r) for r in a.collect()])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = fn(spark, SF_SMALL)
        second = rows_of(b.columns, [tuple(r) for r in b.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == second
