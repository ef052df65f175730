"""Normalised frames: memberships, registry, itemsets, per-subject profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.options import EXCLUDED_CODES
from setscope.session import materialize


def _not_excluded(col: Column, excluded: Sequence) -> Column:
    keep = col.isNotNull()
    if excluded:
        keep = keep & ~col.isin(list(excluded))
    return keep


def memberships(raw: DataFrame, id_cols: Sequence[str], code_col: str,
                flag_col: str | None = None, flag_value: str = "I",
                excluded: Sequence = EXCLUDED_CODES) -> DataFrame:
    """(id string, archive) rows of a raw membership table.

    Keeps rows whose flag equals ``flag_value`` (P1) and whose code is set and
    not excluded (P2); the subject key is the concatenation of ``id_cols``
    (P4). Rows with a NULL key part are dropped (a NULL id never joins).
    Duplicates are kept: code frequencies count them.
    """
    cond = _not_excluded(F.col(code_col), excluded)
    if flag_col is not None:
        cond = cond & (F.col(flag_col) == F.lit(flag_value))
    subject = F.concat(*[F.col(c).cast("string") for c in id_cols])
    return (raw.filter(cond)
            .select(subject.alias("id"), F.col(code_col).alias("archive"))
            .filter(F.col("id").isNotNull()))


def registry(raw: DataFrame, code_col: str, order_cols: Sequence[str], text_col: str | Column,
             excluded: Sequence = EXCLUDED_CODES) -> DataFrame:
    """(archive, description): first trimmed text per code, ordered by ``order_cols``.

    NULL order values come first, as in an ascending sort; ties fall to the
    text itself so the pick is deterministic (A2, P3, P5).
    """
    text = F.trim(F.col(text_col) if isinstance(text_col, str) else text_col)
    order_key = []
    for c in order_cols:
        order_key += [F.col(c).isNotNull(), F.col(c)]
    rank = F.struct(*order_key, text.alias("_t"))
    return (raw.filter(_not_excluded(F.col(code_col), excluded))
            .groupBy(F.col(code_col).alias("archive"))
            .agg(F.min_by(text, rank).alias("description")))


def itemsets(members: DataFrame) -> DataFrame:
    """(id, archives): sorted distinct codes per subject (A1)."""
    return members.groupBy("id").agg(F.sort_array(F.collect_set("archive")).alias("archives"))


def subjects(members: DataFrame) -> DataFrame:
    """(id, archives, occurrences): sorted distinct codes and how often each occurs.

    Duplicate memberships are combined map-side before the shuffle by id, so
    a subject with very many rows never reaches one task unreduced.
    """
    pairs = members.groupBy("id", "archive").agg(F.count(F.lit(1)).cast("int").alias("n"))
    grouped = pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("archive", "n"))).alias("_p"))
    return grouped.select(
        "id",
        F.transform("_p", lambda x: x["archive"]).alias("archives"),
        F.transform("_p", lambda x: x["n"]).alias("occurrences"))


def code_domain(members: DataFrame) -> list:
    """Sorted distinct codes.

    The code domain sizes the feature vectors and PCA, so it is small by
    construction; only the distinct codes, never rows, reach the driver.
    """
    rows = members.select("archive").distinct().orderBy("archive").collect()
    return [r[0] for r in rows]


def code_dictionary(members: DataFrame) -> DataFrame:
    """(archive, place): every distinct code with its place in sorted order, from 0.

    Nothing comes to the driver: range partitions hold the sorted codes, and
    the place is the number of codes in the partitions before plus the one
    in its own. The only unpartitioned window runs over one row a partition.
    """
    ranged = materialize(members.select("archive").where(F.col("archive").isNotNull()).distinct()
                         .repartitionByRange("archive").withColumn("_part", F.spark_partition_id()), "codes")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("archive")) - 1
    return (ranged.withColumn("_own", own).join(starts, "_part")
            .select("archive", (F.col("_start") + F.col("_own")).cast("int").alias("place")))


def sample_rows(df: DataFrame, fraction: float, seed: int = 0,
                keys: Sequence[str] | None = None) -> DataFrame:
    """Deterministic sample (P10).

    With ``keys`` a row is kept when the md5 of its keys and the seed falls
    below ``fraction``: stable under repartitioning and reproducible in SQL.
    Pass the subject key alone to sample whole subjects. Without keys, a
    seeded Bernoulli row sample, as the reference does.
    """
    if not keys:
        return df.sample(fraction=fraction, seed=seed)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.filter(bucket < F.lit(int(fraction * 4294967296)))


def run_stats(members: DataFrame) -> DataFrame:
    """One row of sample counts (A8): rows, subjects and distinct codes."""
    return members.agg(
        F.count(F.lit(1)).alias("sample_rows"),
        F.countDistinct("id").alias("sample_count"),
        F.countDistinct("archive").alias("sample_archives_num"))
