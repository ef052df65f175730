"""A keyed store in hash buckets: an upsert reads and rewrites only the buckets that its keys fall into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.session import materialize
from setscope.sources.results import read_result, upsert_by_key, write_result

BUCKET = "_bucket"
#: Buckets of a store; it must stay the same for the life of a store.
BUCKETS = 64


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    """Bucket of a row by the text of its keys, so equal keys of other number types meet."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def read_store(spark: SparkSession, path: str, fmt: str = "orc") -> DataFrame | None:
    """All rows of a store without their bucket, columns of any upsert; None before the first one."""
    rows = read_result(spark, path, fmt=fmt, missing_ok=True, mergeSchema="true")
    return None if rows is None else rows.drop(BUCKET)


def upsert_store(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (),
                 buckets: int = BUCKETS, fmt: str = "orc") -> int:
    """Overlay ``new`` on the store at ``path`` (see ``upsert_by_key``); returns the buckets written.

    Only buckets that hold a key of ``new`` are read (a filter on the
    partition column) and replaced; the files of all others stay as they
    are. The merged rows are written under ``spark.checkpoint.dir`` first,
    so the replacing write reads nothing that it replaces, and Spark stages
    it and puts whole partitions in place at its commit: a run that breaks
    off before leaves the store as it was, one that breaks off during the
    commit leaves every bucket either old or new, and repeating the upsert
    completes it. At most ``buckets`` numbers come to the driver.
    """
    placed = materialize(new.withColumn(BUCKET, bucket_of(keys, buckets)), "upsert")
    changed = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
    if not changed:
        return 0
    old = read_result(spark, path, fmt=fmt, missing_ok=True, mergeSchema="true")
    old = None if old is None else old.where(F.col(BUCKET).isin(changed)).drop(BUCKET)
    merged = upsert_by_key(old, placed.drop(BUCKET), keys, order).withColumn(BUCKET, bucket_of(keys, buckets))
    # one task a bucket and key range would be one file each: rows of a bucket meet before they are written
    write_result(materialize(merged, "merged").repartition(BUCKET), path, partition_by=BUCKET, fmt=fmt)
    return len(changed)
