"""Catalog and file scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, source: str, fmt: str | None = None,
               schema=None, **options) -> DataFrame:
    """Read a catalog table (``db.table``) or a file dataset.

    A source containing ``/`` is a path; its format is ``fmt`` or the file
    extension (parquet, orc, csv, json), parquet by default.
    """
    if "/" not in source:
        return spark.table(source)
    if fmt is None:
        tail = source.rstrip("/").rsplit(".", 1)
        fmt = tail[1] if len(tail) == 2 and tail[1] in {"parquet", "orc", "csv", "json"} else "parquet"
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(source)


def test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
