"""Result sinks (S2-S5): ORC datasets, tagged layout, keyed upsert."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] | str | None = None,
                 fmt: str = "orc", compression: str = "snappy") -> None:
    """Overwrite ``path`` with ``df`` (S3).

    ``partition_by`` gives the one-directory-per-tag layout (S4), e.g.
    ``("model_type", "analysis_type")`` for the six profile variants. A
    partitioned write replaces only the partitions present in ``df``, so
    several tasks can fill one dataset (k-means and hierarchical diameters).
    """
    writer = df.write.mode("overwrite").option("compression", compression)
    if partition_by:
        writer = (writer.option("partitionOverwriteMode", "dynamic")
                  .partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by)))
    writer.format(fmt).save(path)


def read_result(spark: SparkSession, path: str, schema=None, fmt: str = "orc",
                missing_ok: bool = False, **options) -> DataFrame | None:
    """Read a stored result (S2); with ``missing_ok`` a missing path gives None."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as exc:
        if missing_ok and "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def upsert_by_key(old: DataFrame | None, new: DataFrame, keys: Sequence[str],
                  order: Sequence[str] = ()) -> DataFrame:
    """Overlay ``new`` on ``old``: new rows win per key, other old keys stay.

    One row per key, also on a first run (``old`` None). Of several rows of a
    key in one frame the one with the largest ``order`` columns wins, then
    the one with the smallest hash of all columns. All columns of both frames
    stay: a column that ``new`` lacks keeps its stored value, one that
    ``old`` lacks is NULL for the rows that are not replaced. A union plus a
    ranking per key: works for any table size, no driver map.
    """
    tagged = new.withColumn("_src", F.lit(0))
    stored_only = []
    if old is not None:
        stored_only = [c for c in old.columns if c not in new.columns]
        tagged = tagged.unionByName(old.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in tagged.columns if c != "_src"]
    w = Window.partitionBy(*keys).orderBy("_src", *[F.col(c).desc_nulls_last() for c in order if c in cols],
                                          F.xxhash64(*cols))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = tagged.withColumn("_rk", F.row_number().over(w))
    for c in stored_only:
        # the best stored row follows the new ones of its key
        ranked = ranked.withColumn(c, F.first(F.when(F.col("_src") == 1, F.struct(c)), ignorenulls=True).over(whole)[c])
    return ranked.filter("_rk = 1").select(*cols)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the finished folder ``fresh`` in the place of ``path``; the old one goes last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, old = hadoop.Path(path), hadoop.Path(f"{path}.old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(hadoop.Path(fresh), target)
    fs.delete(old, True)


def _recover(spark: SparkSession, path: str) -> None:
    """Bring back the old folder of a swap that broke off between its two renames."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, old = hadoop.Path(path), hadoop.Path(f"{path}.old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)


def save_upsert(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str],
                schema=None, fmt: str = "orc", order: Sequence[str] = ()) -> DataFrame:
    """Upsert into a stored dataset: a first run starts empty.

    The merged rows are written to a new folder beside ``path``, which takes
    its place when it is complete, so a crash leaves the stored rows whole.
    """
    _recover(spark, path)
    old = read_result(spark, path, schema=schema, fmt=fmt, missing_ok=True)
    merged = upsert_by_key(old, new, keys, order)
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    write_result(merged, fresh, fmt=fmt)
    _swap(spark, fresh, path)
    return read_result(spark, path, schema=merged.schema, fmt=fmt)
