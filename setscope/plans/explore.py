"""Exploration reports: loadings, elbow, silhouette, diameters, dendrograms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.operators.batch_kmeans import Model, assign, costs, fit, silhouettes
from setscope.operators.diameter import itemset_diameter
from setscope.operators.features import explained_variance, top_loadings
from setscope.operators.linkage import centroid_frame, complete_linkage, cut_trees, leaf_order, tree_members
from setscope.operators.tree_diameter import tree_diameters
from setscope.plans.analysis import Analysis
from setscope.session import materialize

TREE = ("analysis_type",)


def fit_models(an: Analysis, ks: dict[str, Sequence[int]], seed: int) -> dict[tuple, Model]:
    """The models of all (analysis type, k), fitted together: ``raw`` on the 0/1 space, ``pca`` on the projected one."""
    return fit(an.base, an.codes, {(t, k): (k, None if t == "raw" else an.pca.pc) for t, own in ks.items() for k in own}, seed=seed)


def top_pcs(spark: SparkSession, an: Analysis, registry: DataFrame, n: int) -> DataFrame:
    return top_loadings(spark, an.pca, an.codes, registry, n)


def pc_explained_variance(spark: SparkSession, an: Analysis) -> DataFrame:
    return explained_variance(spark, an.pca)


def assigned(an: Analysis, models: dict[tuple, Model], names: Sequence[str]) -> DataFrame:
    """(archives, weight, assigned): each itemset once, with its cluster under every model.

    ``models`` are keyed by tuples of ``names``; ``assigned`` is an array of
    (names..., prediction). All models run over the base in one pass.
    """
    keys = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, key, strict=True)]) for key in models])
    return assign(an.base, list(models.values())).select("archives", "weight", F.zip_with(
        keys, "labels", lambda k, p: F.struct(*[k[n].alias(n) for n in names], p.alias("prediction"))).alias("assigned"))


def exploded(wide: DataFrame) -> DataFrame:
    """(names..., prediction, archives, weight): one row per itemset and model of ``assigned``."""
    return wide.select("archives", "weight", F.explode("assigned").alias("_a")).select("_a.*", "archives", "weight")


def _by_model(spark: SparkSession, rows: DataFrame, models: dict[tuple, Model], value: str) -> DataFrame:
    """(cluster = k, value, analysis_type) of rows that name a model by its place."""
    names = spark.createDataFrame([(i, int(k), t) for i, (t, k) in enumerate(models)], "model int, cluster int, analysis_type string")
    return rows.join(names, "model").select("cluster", value, "analysis_type")


def elbow_report(an: Analysis, models: dict[tuple, Model]) -> DataFrame:
    """(cluster = k, cost, analysis_type): weighted squared distances to the centres of every (type, k) model."""
    return _by_model(an.base.sparkSession, costs(an.base, list(models.values())), models, "cost")


def silhouette_report(an: Analysis, wide: DataFrame, models: dict[tuple, Model]) -> DataFrame:
    """(cluster = k, score, analysis_type): silhouette on the raw 0/1 vectors for every model of ``wide`` (``assigned``)."""
    points = wide.select("archives", "weight", F.transform("assigned", lambda a: a["prediction"]).alias("labels"))
    return _by_model(wide.sparkSession, silhouettes(points, [m.k for m in models.values()], an.codes), models, "score")


def diameter_report(preds: DataFrame, model_type: str, codes: Sequence, key: str = "k") -> DataFrame:
    """(cluster = key, prediction, value, analysis_type, model_type): diameter of each cluster."""
    d = itemset_diameter(preds, [key, "analysis_type", "prediction"], codes=codes)
    return d.select(F.col(key).alias("cluster"), "prediction", "value", "analysis_type",
                    F.lit(model_type).alias("model_type"))


@dataclass
class Trees:
    """The complete-linkage trees of one model per analysis type, built in one run."""

    merges: DataFrame
    members: DataFrame
    n: int

    def cuts(self, ts: Sequence[int]) -> DataFrame:
        return cut_trees(self.merges, self.n, ts, TREE, self.members)

    def leaf_order(self) -> DataFrame:
        return leaf_order(self.merges, self.n, TREE, self.members)


def linkage_of(spark: SparkSession, models: dict[str, Model]) -> Trees:
    """Trees over the centres of each analysis type's model; the models have one k."""
    points = None
    for t, m in models.items():
        own = centroid_frame(spark, m.centres(), analysis_type=t)
        points = own if points is None else points.unionByName(own)
    n = next(iter(models.values())).k
    merges = materialize(complete_linkage(points, n, TREE), "merges")
    return Trees(merges, materialize(tree_members(merges, n, TREE), "members"), n)


def hierarchical_diameters(an: Analysis, models: dict[str, Model], trees: Trees, ts: Sequence[int]) -> DataFrame:
    """(cluster = t, prediction, value, analysis_type, model_type): diameter of every flat group of every cut."""
    points = exploded(assigned(an, {(t,): m for t, m in models.items()}, TREE)).withColumnRenamed("prediction", "leaf")
    found = tree_diameters(points, trees.merges, trees.members, materialize(trees.cuts(ts), "cuts"), an.codes, TREE)
    return found.select(F.col("t").alias("cluster"), F.col("cluster").alias("prediction"), "value", "analysis_type",
                        F.lit("hierarchical").alias("model_type"))


def hierarchical_predictions(an: Analysis, models: dict[str, Model], trees: Trees,
                             ts: Sequence[int]) -> DataFrame:
    """(t, analysis_type, archives, weight, prediction = flat cluster) for every cut t of every tree."""
    cuts = trees.cuts(ts).select(*TREE, F.col("node").alias("prediction"), "t", F.col("cluster").alias("_flat"))
    first = exploded(assigned(an, {(t,): m for t, m in models.items()}, TREE))
    return first.join(cuts, [*TREE, "prediction"]).drop("prediction").withColumnRenamed("_flat", "prediction")


def dendrogram_report(trees: Trees) -> tuple[DataFrame, DataFrame]:
    """Merge table and leaf order of every tree, with its analysis type."""
    return (trees.merges.select("step", "left", "right", "height", "size", *TREE),
            trees.leaf_order().select("position", "node", *TREE))
