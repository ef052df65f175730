from conftest import SF_SMALL
from setscope.operators.describe import describe_array
from setscope.operators.diameter import itemset_diameter
from setscope.operators.profiles import itemset_counts, itemset_occurrences, top_itemsets, trend_itemsets
from setscope.sources import bindings as B
from setscope.sources.memberships import itemsets


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_filters_and_prunes_columns(spark):
    m, _ = B.order_nation(spark, SF_SMALL)
    plan = _plan(m)
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linestatus:string>" in plan


def test_no_python_in_describe_diameter_and_profiles(spark):
    m, reg = B.order_nation(spark, SF_SMALL)
    items = itemsets(m)
    assign = B.order_rule_clusters(spark, SF_SMALL, "B1")
    top = top_itemsets(itemset_counts(items, assign), 15)
    for df in (describe_array(items, ["archives"], reg), itemset_diameter(items.join(assign, "id"), ["cluster"]),
               trend_itemsets(top, reg)):
        plan = _plan(df)
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_top_n_is_limited_before_the_shuffle(spark):
    m, _ = B.order_nation(spark, SF_SMALL)
    occ = itemset_occurrences(itemset_counts(itemsets(m), B.order_rule_clusters(spark, SF_SMALL, "B1")), 15)
    occ.collect()
    assert "WindowGroupLimit" in _plan(occ)


def test_no_cartesian_or_nested_loop_join_in_any_registered_query(spark):
    from setscope.plans.catalog import QUERIES

    for name, fn in QUERIES.items():
        df = fn(spark, SF_SMALL)
        df.collect()
        plan = _plan(df)
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def _scans(df, table):
    df.collect()
    return sum(1 for line in _plan(df).split("== Initial Plan ==")[0].splitlines() if "FileScan parquet" in line and table in line)


def test_given_tables_are_scanned_once(spark):
    from setscope.plans import catalog

    assert _scans(catalog.q_wcss(spark, SF_SMALL), "l_orderkey") == 1
    assert _scans(catalog.q_trend_itemsets(spark, SF_SMALL), "l_linestatus") == 1
