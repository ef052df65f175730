from pyspark.sql import functions as F

from setscope.operators.profiles import (
    code_frequencies, code_frequencies_assigned, itemset_counts, itemset_occurrences, trend_itemsets)
from setscope.sources.memberships import itemsets, subjects


def _frames(spark):
    m = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 3), ("d", 3), ("e", 4), ("f", 5)],
        "id string, archive int")
    assign = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 0), ("f", 1)],
                                   "id string, cluster int")
    return m, assign


def test_code_frequencies_counts_duplicates(spark):
    m, assign = _frames(spark)
    got = {(r.cluster, r.archive): r.archive_occurrences for r in code_frequencies(m, assign).collect()}
    assert got[(0, 1)] == 4 and got[(0, 2)] == 2 and got[(1, 5)] == 1
    assigned = subjects(m).join(assign, "id")
    same = {(r.cluster, r.archive): r.archive_occurrences for r in code_frequencies_assigned(assigned).collect()}
    assert same == got


def test_truncated_share_and_ties(spark):
    m, assign = _frames(spark)
    counts = itemset_counts(itemsets(m), assign)
    occ = itemset_occurrences(counts, 2)
    rows = {(r.cluster, tuple(r.archives)): (r.archives_occurrences, r.relative_frequency) for r in occ.collect()}
    # cluster 0: {1,2} x2, {3} x2, {4} x1 -> top 2 kept, share of the whole cluster (5)
    assert rows == {(0, (1, 2)): (2, 0.4), (0, (3,)): (2, 0.4), (1, (5,)): (1, 1.0)}
    reg = spark.createDataFrame([(1, "one")], "archive int, description string")
    trend = {(r.cluster, tuple(r.archives)): (r.relative_frequency, r.archives_description)
             for r in trend_itemsets(occ, reg).collect()}
    # both tied itemsets kept; share over the top-n rows only (2 / 4)
    assert trend == {(0, (1, 2)): (0.5, "[1: one, 2]"), (0, (3,)): (0.5, "[3]"), (1, (5,)): (1.0, "[5]")}


def test_top_n_cut_is_deterministic_on_ties(spark):
    m, assign = _frames(spark)
    counts = itemset_counts(itemsets(m), assign)
    one = {tuple(r.archives) for r in itemset_occurrences(counts, 1).filter("cluster = 0").collect()}
    assert one == {(1, 2)}  # tie on count 2 broken by the itemset


def test_results_equal_across_shuffle_partitions(spark):
    m, assign = _frames(spark)
    def run():
        counts = itemset_counts(itemsets(m), assign)
        return sorted(tuple(r) for r in itemset_occurrences(counts, 2)
                      .withColumn("archives", F.col("archives").cast("string")).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    a = run()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b
