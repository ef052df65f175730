"""Per-cluster profiles: code frequencies, itemset occurrences, trend itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setscope.operators.describe import describe_array
from setscope.operators.reshape import top_n_by


def code_frequencies(members: DataFrame, assignments: DataFrame,
                     cluster_col: str = "cluster", by: tuple[str, ...] = ()) -> DataFrame:
    """(cluster, archive, archive_occurrences): membership rows per cluster and code.

    Duplicate memberships count. They are first combined per (id, code)
    map-side, so a subject with a huge number of rows shrinks to one row per
    code before the join on id. ``by`` carries extra grouping columns of the
    assignments (e.g. model_type, analysis_type) so several variants are
    profiled in one pass.
    """
    pairs = members.groupBy("id", "archive").agg(F.count(F.lit(1)).alias("_n"))
    assign = assignments.select("id", *by, F.col(cluster_col).alias("cluster"))
    return (pairs.join(assign, "id")
            .groupBy(*by, "cluster", "archive")
            .agg(F.sum("_n").cast("int").alias("archive_occurrences")))


def code_frequencies_assigned(assigned: DataFrame, cluster_col: str = "cluster",
                              by: tuple[str, ...] = ()) -> DataFrame:
    """T1 from assigned subject profiles (id, archives, occurrences, cluster): no join."""
    return (assigned.select(*by, F.col(cluster_col).alias("cluster"),
                            F.explode(F.arrays_zip("archives", "occurrences")).alias("_e"))
            .groupBy(*by, "cluster", F.col("_e.archives").alias("archive"))
            .agg(F.sum("_e.occurrences").cast("int").alias("archive_occurrences")))


def itemset_counts(items: DataFrame, assignments: DataFrame | None, cluster_col: str = "cluster",
                   by: tuple[str, ...] = ()) -> DataFrame:
    """(cluster, archives, archives_occurrences): subjects per cluster and itemset (A5).

    Items are left-joined to the assignments (unassigned subjects form a
    NULL cluster); with ``assignments=None`` the items frame already carries
    the cluster column.
    """
    if assignments is not None:
        assign = assignments.select("id", *by, F.col(cluster_col).alias("cluster"))
        joined = items.join(assign, "id", "left")
    else:
        joined = items.withColumnRenamed(cluster_col, "cluster")
    return (joined.groupBy(*by, "cluster", "archives")
            .agg(F.count(F.lit(1)).cast("int").alias("archives_occurrences")))


def top_itemsets(counts: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` most frequent itemsets of each cluster; ties on the count by itemset."""
    return top_n_by(counts, [*by, "cluster"], [F.desc("archives_occurrences"), F.asc("archives")], n)


def itemset_occurrences(counts: DataFrame, n: int, by: tuple[str, ...] = (),
                        top: DataFrame | None = None) -> DataFrame:
    """Top ``n`` itemsets per cluster with their share of the whole cluster.

    The cluster total is a grouped sum joined back (one small row per
    cluster) instead of a window over every itemset of a cluster; the top-n
    is a ranking filter that Spark limits per partition before the shuffle.
    ``top`` are the ``top_itemsets`` of ``counts``, if the caller has them.
    """
    keys = [*by, "cluster"]
    totals = counts.groupBy(*keys).agg(F.sum("archives_occurrences").alias("_total"))
    top = top_itemsets(counts, n, by) if top is None else top
    cond = [top[k].eqNullSafe(totals[k]) for k in keys]
    joined = top.join(totals, cond, "inner").select(*[top[k] for k in keys], top["archives"],
                                                    top["archives_occurrences"], totals["_total"])
    return (joined.withColumn("relative_frequency",
                              F.round(F.col("archives_occurrences") / F.col("_total"), 5))
            .drop("_total"))


def trend_itemsets(top: DataFrame, registry: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent itemset(s) of each cluster among its top-n rows, described.

    ``top`` are the rows of ``top_itemsets``. A cluster's rows are at most n,
    so one aggregate gathers them; all rows that reach their maximum stay, and
    the share is that of the gathered rows.
    """
    keys = [*by, "cluster"]
    row = F.struct("archives", "archives_occurrences")
    gathered = top.groupBy(*keys).agg(F.collect_list(row).alias("_rows"))
    counts = F.transform("_rows", lambda r: r["archives_occurrences"])
    highest = gathered.select(*keys, "_rows", F.array_max(counts).alias("_most"),
                              F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c).alias("_all"))
    best = highest.select(*keys, "_all", F.explode(
        F.filter("_rows", lambda r: r["archives_occurrences"] == F.col("_most"))).alias("_row"))
    return describe_array(best.select(
        *keys, F.col("_row")["archives"].alias("archives"),
        F.col("_row")["archives_occurrences"].alias("archives_occurrences"),
        F.round(F.col("_row")["archives_occurrences"] / F.col("_all"), 5).alias("relative_frequency")),
        ["archives"], registry)
