"""Code descriptions and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.text import segment_text as _segments


def describe_code(df: DataFrame, registry: DataFrame, code_col: str = "archive",
                  out_col: str | None = None) -> DataFrame:
    """Left join of a scalar code column to its description.

    Plain equi join: the planner broadcasts the registry when its size
    estimate is under the broadcast threshold and shuffles otherwise.
    """
    out_col = out_col or f"{code_col}_description"
    reg = registry.select(F.col("archive").alias(code_col), F.col("description").alias(out_col))
    return df.join(reg, code_col, "left")


def describe_array(df: DataFrame, columns: Sequence[str], registry: DataFrame) -> DataFrame:
    """Add ``<col>_description`` = ``[code: text, code: text]`` for array columns.

    Work is done once per distinct array over all the given columns: explode
    with positions, join the registry (a code without description shows the
    bare code), re-assemble in array order, then join back on each column's
    array value. No driver-side map and no Python UDF; every step is a
    distributed join or aggregate.
    """
    if not columns:
        raise ValueError("describe_array: name the array columns to describe")
    reg = registry.select(F.col("archive").alias("_code"), F.col("description").alias("_text"))
    keys = None
    for col in columns:
        part = df.select(F.col(col).alias("_arr")).where(F.col("_arr").isNotNull())
        keys = part if keys is None else keys.unionByName(part)
    parts = (keys.distinct().select("_arr", F.posexplode("_arr").alias("_pos", "_code"))
             .join(reg, "_code", "left")
             .select("_arr", "_pos", F.when(F.col("_text").isNull(), F.col("_code").cast("string"))
                     .otherwise(F.concat(F.col("_code").cast("string"), F.lit(": "), F.col("_text")))
                     .alias("_entry")))
    text = (parts.groupBy("_arr")
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "_entry"))).alias("_e"))
            .select("_arr", F.concat(F.lit("["), F.array_join(F.transform("_e", lambda e: e["_entry"]), ", "),
                                     F.lit("]")).alias("_desc")))
    for col in columns:
        out = f"{col}_description"
        df = (df.join(text, df[col] == text["_arr"], "left")
              .withColumn(out, F.when(F.col(col).isNull(), F.lit(None).cast("string"))
                          .otherwise(F.coalesce(F.col("_desc"), F.lit("[]"))))
              .drop("_arr", "_desc"))
    return df


def tag(df: DataFrame, **literals) -> DataFrame:
    """Constant tag columns, e.g. ``analysis_type="raw"``."""
    for name, value in literals.items():
        df = df.withColumn(name, F.lit(value))
    return df


def segment_rows(df: DataFrame, key: str, col: str, length: int) -> DataFrame:
    """(key, index, content): each whole text as numbered fixed-length pieces."""
    return df.select(key, F.posexplode(_segments(col, length)).alias("index", "content"))
