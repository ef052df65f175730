"""Connected components of an edge table, in rounds of star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.llm.joins import salted_join
from setscope.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
        edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    low = both.groupBy("u").agg(F.min("w").alias("low"))
    moved = salted_join(both.where("w > u"), low, ["u"], F.col("w")).select(F.col("w").alias("v"), F.least("u", "low").alias("m"))
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("v").agg(F.min("m").alias("low"))
    moved = salted_join(edges, low, ["v"], F.col("m")).where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
    return moved.unionByName(low.select("v", F.col("low").alias("m"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) edges; a component is named by its smallest node.

    Alternates the large-star and small-star operations until no edge moves.
    Minima combine map-side and a node's neighbours meet the minimum under a
    salt, so a node of very many edges is spread over tasks; the edge table
    never grows. Each round is written under ``spark.checkpoint.dir``.
    Nulls and loops are dropped; an empty table gives an empty result.
    """
    state = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
        if now == mark or now[0] == 0:
            return state.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
                state.select(F.col("m").alias("node"), F.col("m").alias("component"))).distinct()
        mark = now
        state = materialize(_small_star(_large_star(state)), "edges")
