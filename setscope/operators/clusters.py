"""Wcss and silhouette of given clusterings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.session import materialize


def set_entries(items_col: str = "archives"):
    """Entries of a 0/1 itemset vector: one (dim = code, value 1.0) per code."""
    return F.transform(items_col, lambda c: F.struct(c.alias("dim"), F.lit(1.0).alias("value")))


def wcss(points: DataFrame, by: Sequence[str] = (), cluster_col: str = "cluster") -> DataFrame:
    """(by..., cluster, size, wcss): within-cluster sum of squared distances to the mean.

    ``points`` (by..., cluster, weight, entries) holds weighted points with
    their non-zero coordinates as array<struct<dim, value>>. Per cluster and
    dimension sum(w v^2) - sum(w v)^2 / n; an entry without dimension counts
    the weights, so one pass and two aggregates do it, without a join.
    """
    keys = [*by, cluster_col]
    size = F.array(F.struct(F.lit(None).alias("dim"), F.lit(1.0).alias("value")))
    w, v = F.col("weight").cast("double"), F.col("e.value")
    per_dim = (points.select(*keys, "weight", F.explode(F.concat(size, F.col("entries"))).alias("e"))
               .groupBy(*keys, F.col("e.dim").alias("dim")).agg(F.sum(w * v).alias("s1"), F.sum(w * v * v).alias("s2")))
    marker = F.col("dim").isNull()
    totals = per_dim.groupBy(*keys).agg(
        F.max(F.when(marker, F.col("s1"))).alias("n"), F.sum(F.when(~marker, F.col("s2"))).alias("squares"),
        F.sum(F.when(~marker, F.col("s1") * F.col("s1"))).alias("sums"))
    return totals.select(*keys, F.col("n").cast("long").alias("size"),
                         F.coalesce(F.col("squares") - F.col("sums") / F.col("n"), F.lit(0.0)).alias("wcss"))


def weighted_silhouette(points: DataFrame, by: Sequence[str] = (), cluster_col: str = "cluster",
                        weight_col: str = "weight", entries_col: str = "entries") -> DataFrame:
    """(by..., score): mean silhouette (squared Euclidean) of weighted points.

    ``points`` (by..., cluster, weight, entries) where ``entries`` is the
    point's non-zero coordinates as array<struct<dim, value>>. A point of
    weight w stands for w equal subjects and the result equals the
    unweighted silhouette over all subjects. Closed form through cluster
    sums, as MLlib's evaluator: for cluster c, S(i, c) = q_i n_c + psi_c -
    2 x_i . Y_c with n_c the subjects, psi_c the sum of q = |x|^2 and Y_c
    the coordinate sums of c; a = S(i, own) / (n_own - 1), b = min over
    other c of S(i, c) / n_c.

    The per-cluster sums of a clustering (k rows, each with at most one
    entry per dimension) are written once and joined to every point of that
    clustering, by the planner's choice of join, and every S(i, c) is computed
    in the row: O(points x k x non-zeros) arithmetic, no pairing of points and
    no point x cluster rows.
    """
    keys = [*by] or ["_all"]
    # one clustering is keyed by a value that is 0 for every cluster, so the join stays an equi join
    points = points if by else points.withColumn("_all", F.pmod(F.xxhash64(cluster_col), F.lit(1)))
    q = F.aggregate(entries_col, F.lit(0.0), lambda acc, e: acc + e["value"] * e["value"])
    p = points.select(*keys, F.col(cluster_col).alias("_c"), F.col(weight_col).cast("double").alias("_w"),
                      F.col(entries_col).alias("_e"), q.alias("q"))
    totals = p.groupBy(*keys, "_c").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("q")).alias("psi"))
    sums = (p.select(*keys, "_c", "_w", F.explode("_e").alias("_x"))
            .groupBy(*keys, "_c", F.col("_x.dim").alias("dim"))
            .agg(F.sum(F.col("_w") * F.col("_x.value")).alias("y"))
            .groupBy(*keys, "_c").agg(F.map_from_entries(F.collect_list(F.struct("dim", "y"))).alias("ym")))
    per_cluster = materialize(totals.join(sums, [*keys, "_c"], "left"), "cluster-sums")
    stats = per_cluster.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_c").alias("c"), "n", "psi", "ym")).alias("_st"))
    joined = p.join(stats, keys).withColumn("_own", F.filter("_st", lambda st: st["c"] == F.col("_c"))[0])

    def s_of(n, psi, ym):
        dot = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(
            F.try_element_at(ym, e["dim"]), F.lit(0.0)))
        return F.col("q") * n + psi - 2 * dot

    own = F.col("_own")
    a = s_of(own["n"], own["psi"], own["ym"]) / (own["n"] - 1)
    # one pass over the other clusters keeping the smallest mean distance
    b = F.aggregate("_st", F.lit(None).cast("double"),
                    lambda acc, st: F.when(st["c"] == F.col("_c"), acc)
                    .otherwise(F.least(acc, s_of(st["n"], st["psi"], st["ym"]) / st["n"])))
    sil = (F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0))
           .when(a < b, 1 - a / b).when(a > b, b / a - 1).otherwise(F.lit(0.0)))
    per_point = joined.select(*keys, "_w", sil.alias("_s"))
    return per_point.groupBy(*by).agg((F.sum(F.col("_w") * F.col("_s")) / F.sum("_w")).alias("score"))
