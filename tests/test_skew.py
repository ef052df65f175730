"""Skewed inputs: one subject with a third of all rows, one itemset held by a third of subjects."""

from pyspark.sql import functions as F

from setscope.operators.profiles import code_frequencies
from setscope.plans.analysis import itemset_base
from setscope.sources.memberships import itemsets, subjects


def _skewed(spark):
    hot = spark.range(6000).select(F.lit("hot").alias("id"), (F.col("id") % 3).cast("int").alias("archive"))
    common = spark.range(4000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"),
                                      F.lit(7).alias("archive"))
    rest = spark.range(8000).select(F.concat(F.lit("r"), (F.col("id") % 2000).cast("string")).alias("id"),
                                    (F.col("id") % 11).cast("int").alias("archive"))
    return hot.unionByName(common).unionByName(rest)


def test_hot_subject_and_hot_itemset_give_whole_exact_results(spark):
    m = _skewed(spark)
    assert m.count() == 18000
    sub = {r.id: (r.archives, r.occurrences) for r in subjects(m).filter("id = 'hot'").collect()}
    assert sub["hot"] == ([0, 1, 2], [2000, 2000, 2000])
    weights, code_counts = itemset_base(subjects(m))
    w = {tuple(r.archives): r.weight for r in weights.collect()}
    assert w[(7,)] == 4000 and sum(w.values()) == itemsets(m).count()
    cc = {(tuple(r.archives), r.archive): r.n for r in code_counts.collect()}
    assert cc[((0, 1, 2), 1)] == 2000
    assign = subjects(m).select("id", F.when(F.col("id") == "hot", 1).otherwise(0).alias("cluster"))
    freq = {(r.cluster, r.archive): r.archive_occurrences for r in code_frequencies(m, assign).collect()}
    assert freq[(1, 0)] == 2000 and sum(freq.values()) == 18000
