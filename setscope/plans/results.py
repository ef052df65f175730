"""Cluster variants and their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.arrays import array_text
from setscope.operators.batch_kmeans import Model
from setscope.operators.profiles import itemset_occurrences, top_itemsets, trend_itemsets
from setscope.operators.reshape import relabel, union_tagged
from setscope.plans.analysis import Analysis
from setscope.plans.explore import Trees, assigned, exploded
from setscope.session import materialize

TAGS = ("model_type", "analysis_type")


def model_variants(an: Analysis, optimal: dict[str, Model], big: dict[str, Model], trees: Trees,
                   cut: dict[str, int]) -> DataFrame:
    """(model_type, analysis_type, archives, weight, cluster) of the six variants, one pass over the base.

    Per analysis type: the optimal-k model, the big-K model, and the big-K
    model relabelled to the flat groups of its tree at ``cut`` (J3).
    """
    models = {}
    for at in optimal:
        models["opt_k_kmeans", at] = optimal[at]
        models["K_kmeans", at] = big[at]
    flat = exploded(assigned(an, models, TAGS)).withColumnRenamed("prediction", "cluster")
    key = F.concat_ws("/", "analysis_type", F.col("cluster").cast("string"))
    cuts = trees.cuts(sorted(set(cut.values())))
    wanted = " or ".join(f"(analysis_type = '{at}' and t = {t})" for at, t in cut.items())
    mapping = cuts.filter(wanted).withColumnRenamed("cluster", "_flat").withColumnRenamed("node", "cluster").select(
        key.alias("_key"), "_flat")
    two_stage = relabel(flat.filter("model_type = 'K_kmeans'").withColumn("_key", key).drop("cluster"), mapping,
                        "_key", "_flat").withColumnRenamed("_key", "cluster")
    return flat.unionByName(two_stage.withColumn("model_type", F.lit("hierarchical")))


def cluster_variants(parts: list[tuple[dict, DataFrame]]) -> DataFrame:
    """One tagged frame (model_type, analysis_type, archives, weight, cluster) (T4)."""
    return union_tagged(parts)


def profiles(code_counts: DataFrame, variants: DataFrame, registry: DataFrame, n: int) -> dict[str, DataFrame]:
    """archives_frequencies, archives_occurrences and trend_vector for all variants at once.

    ``variants`` (model_type, analysis_type, archives, weight, cluster) gives each
    distinct itemset's cluster per variant; ``code_counts`` (archives, archive, n)
    the code occurrences behind each itemset (``Analysis.code_counts``).
    """
    freq = (code_counts.join(variants.select(*TAGS, "archives", "cluster"), "archives")
            .groupBy(*TAGS, "cluster", "archive")
            .agg(F.sum("n").cast("int").alias("archive_occurrences")))
    counts = (variants.groupBy(*TAGS, "cluster", "archives")
              .agg(F.sum("weight").cast("int").alias("archives_occurrences")))
    top = materialize(top_itemsets(counts, n, by=TAGS), "top-itemsets")
    occ = itemset_occurrences(counts, n, by=TAGS, top=top)
    trend = trend_itemsets(top, registry, by=TAGS)
    return {
        "archives_frequencies": freq.select("cluster", "archive", "archive_occurrences", *TAGS[::-1]),
        "archives_occurrences": occ.select("cluster", array_text("archives").alias("archives"),
                                           "archives_occurrences", "relative_frequency", *TAGS[::-1]),
        "trend_vector": trend.select("cluster", array_text("archives").alias("archives"), "archives_occurrences",
                                     "relative_frequency", "archives_description", *TAGS[::-1]),
    }
