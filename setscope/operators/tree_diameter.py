"""Diameters of all flat groups of a merge tree at once.

Two points of a group meet in the tree at one merge, the lowest one above both
of their leaves. So the diameter of a group is the largest of its leaves' own
diameters and of the farthest pairs across the merges inside it, and each pair
of points is looked at once for a tree, not once for every cut that holds it.
Across a merge only pairs that can beat what its subtree already shows meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.operators.diameter import SALTS, _bits, _set_d2, itemset_diameter, pack_items
from setscope.session import materialize


def tree_diameters(points: DataFrame, merges: DataFrame, members: DataFrame, cuts: DataFrame, codes: Sequence,
                   keys: Sequence[str] = (), items_col: str = "archives") -> DataFrame:
    """(keys..., t, cluster, value): diameter of every flat group with a point, for every cut ``t``.

    ``points`` (keys..., leaf, itemset) lie in the leaves of the trees
    (``merges``, ``members`` and ``cuts`` as from ``linkage``); a leaf may
    have no points. A group of one distinct point has diameter 0.0.
    """
    keys = list(keys)
    n = max(1, -(-len(codes) // 64))
    d2 = lambda a, b: _set_d2(a, b, n)
    leaves = materialize(itemset_diameter(points, [*keys, "leaf"], items_col, codes).select(
        *keys, F.col("leaf").alias("node"), F.round(F.col("value") * F.col("value")).cast("int").alias("own2")), "leaf-diameters")
    packed = points.select(*keys, F.col("leaf").alias("node"), pack_items(items_col, codes).alias("_p")).distinct()
    placed = materialize(packed.withColumn("_s", _bits(F.col("_p"), n)).join(members, [*keys, "node"]).select(
        *keys, "step", "is_right", "_p", "_s"), "tree-points")
    # a merge by one of its leaves: what holds that leaf and no fewer leaves holds the merge
    inside = materialize(members.groupBy(*keys, "step").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("size")), "merges")

    # a lower bound across each merge: the largest set on the left, the farthest from it on the right, and back
    side = lambda right: placed.where("is_right" if right else "not is_right").drop("is_right")
    start = side(False).groupBy(*keys, "step").agg(F.max(F.struct("_s", "_p")).alias("m")).select(
        *keys, "step", F.col("m._p").alias("_q"))

    def farthest(right: bool, pivot: DataFrame) -> DataFrame:
        met = side(right).join(pivot, [*keys, "step"]).withColumn("_d", d2(F.col("_p"), F.col("_q")))
        return materialize(met.groupBy(*keys, "step").agg(F.max(F.struct("_d", "_p")).alias("m")).select(
            *keys, "step", F.col("m._p").alias("_q"), F.col("m._d").alias("_d")), "pivots")

    one = farthest(True, start)
    two = farthest(False, one.drop("_d"))
    # and for the whole subtree, with the leaves' diameters
    shown = inside.join(two.select(*keys, "step", F.col("_d").alias("cross2")), [*keys, "step"]).select(
        *keys, "node", F.col("size").alias("own_size"), F.col("cross2").alias("value2")).unionByName(
        leaves.select(*keys, "node", F.lit(1).cast("long").alias("own_size"), F.col("own2").alias("value2")))
    above = members.select(*keys, "node", "step").join(inside.select(*keys, "step", "size"), [*keys, "step"])
    bound = materialize(shown.join(above, [*keys, "node"]).where("own_size <= size").groupBy(*keys, "step").agg(
        F.max("value2").alias("_lb")), "bounds")

    # |x|^2 + |y|^2 bounds the distance of 0/1 points: partners by size, salted
    largest = side(True).groupBy(*keys, "step").agg(F.max("_s").alias("_most"))
    left = side(False).join(bound, [*keys, "step"]).join(largest, [*keys, "step"]).where(F.col("_s") + F.col("_most") > F.col("_lb")).select(
        *keys, "step", F.col("_p").alias("_a"), F.explode(F.sequence(
            F.greatest(F.col("_lb") + 1 - F.col("_s"), F.lit(1)), F.greatest(F.col("_most"), F.lit(1)))).alias("_s")).select(
        "*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    right = side(True).withColumn("_salt", F.pmod(F.xxhash64("_p"), F.lit(SALTS)).cast("int"))
    pairs = left.join(right, [*keys, "step", "_s", "_salt"]).groupBy(*keys, "step").agg(
        F.max(d2(F.col("_a"), F.col("_p"))).alias("pair2"))
    cross = two.select(*keys, "step", "_d").join(pairs, [*keys, "step"], "left").select(
        *keys, "step", F.greatest("_d", F.coalesce("pair2", F.lit(0))).alias("value2"))

    groups = cuts.groupBy(*keys, "t", "cluster").agg(F.count(F.lit(1)).alias("held"))
    found = leaves.select(*keys, "node", F.lit(1).cast("long").alias("size"), F.col("own2").alias("value2")).unionByName(
        cross.join(inside, [*keys, "step"]).select(*keys, "node", "size", "value2"))
    return (found.join(cuts, [*keys, "node"]).join(groups, [*keys, "t", "cluster"]).where("size <= held")
            .groupBy(*keys, "t", "cluster").agg(F.sqrt(F.max("value2").cast("double")).alias("value")))
