"""The shared analysis frames: distinct itemsets with weights, features, PCA.

Every clustering metric here depends on a subject only through its itemset,
so the work runs on one row per distinct itemset carrying ``weight`` =
number of subjects. K-means uses the weight (same objective as fitting all
subjects); silhouette, wcss, diameter and profiles are exact under it. The
PCA fit runs on the subject-level vectors (MLlib's PCA has no weights).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark import StorageLevel
from pyspark.sql import functions as F

from setscope.operators.features import PcaSelection, weighted_pca
from setscope.options import Options
from setscope.session import materialize
from setscope.sources.memberships import code_domain, subjects


@dataclass
class Analysis:
    codes: list
    base: DataFrame          # archives, weight (persisted)
    code_counts: DataFrame   # archives, archive, n: code occurrences over the itemset's subjects
    pca: PcaSelection

    def release(self) -> None:
        self.base.unpersist()


def itemset_base(subj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archives, weight) per distinct itemset and (archives, archive, n): the code
    occurrences summed over the itemset's subjects. Both are map-side combined."""
    weights = subj.groupBy("archives").agg(F.count(F.lit(1)).alias("weight"))
    code_counts = (subj.select("archives", F.explode(F.arrays_zip("archives", "occurrences")).alias("_e"))
                   .groupBy("archives", F.col("_e.archives").alias("archive"))
                   .agg(F.sum("_e.occurrences").alias("n")))
    return weights, code_counts


def build_analysis(members: DataFrame, opts: Options = Options()) -> Analysis:
    """Subjects, distinct-itemset base, PCA fit, code counts.

    The base is hash-partitioned by itemset into ``opts.base_partitions``
    partitions. The memberships are read once and the subjects written; the
    base is cached until ``release``.
    """
    weights, code_counts = itemset_base(materialize(subjects(members), "subjects"))
    base = weights.repartition(opts.base_partitions, "archives").persist(StorageLevel.MEMORY_AND_DISK)
    codes = held_codes(base)
    return Analysis(codes, base, code_counts, weighted_pca(base, codes, opts.variance_low, opts.variance_high))


def held_codes(sets: DataFrame) -> list:
    """The code domain of the memberships behind some distinct itemsets."""
    return code_domain(sets.select(F.explode("archives").alias("archive")))
