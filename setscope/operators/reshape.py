"""Reshaping helpers: melt, top-n per group, relabel, tagged union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "pc",
         value_name: str = "loading") -> DataFrame:
    """Wide to long (A10)."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


def top_n_by(df: DataFrame, partition: Sequence[str | Column], order: Sequence[Column], n: int) -> DataFrame:
    """Rows ranked 1..n per partition by ``order``.

    A ``row_number`` filter: Spark plans it as a group limit applied on each
    map partition before the exchange, so at most n rows per group move.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def relabel(assignments: DataFrame, mapping: DataFrame, col: str = "prediction",
            new_col: str = "hier_prediction") -> DataFrame:
    """Replace ``col`` by its mapped value (J3); unmapped values become NULL.

    ``mapping`` (col, new_col) may have any size: the planner broadcasts it
    when it is small enough.
    """
    return (assignments.join(mapping.select(col, new_col), col, "left").drop(col).withColumnRenamed(new_col, col))


def union_tagged(parts: Sequence[tuple[dict, DataFrame]]) -> DataFrame:
    """UNION ALL of frames, each tagged with constant columns."""
    out = None
    for tags, df in parts:
        for name, value in tags.items():
            df = df.withColumn(name, F.lit(value))
        out = df if out is None else out.unionByName(df)
    return out
