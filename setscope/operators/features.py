"""Indicator matrix, feature vectors and PCA (A3, M4-M8)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, PCAModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from setscope.operators.describe import describe_code
from setscope.operators.reshape import melt, top_n_by
from setscope.session import scratch_folder


def one_hot(items: DataFrame, codes: Sequence) -> DataFrame:
    """(id, <code>...): 0/1 indicator per code, one column per code in order.

    Built from the itemsets (one aggregate by subject) rather than a second
    pivot aggregate over the memberships.
    """
    return items.select("id", *[F.array_contains("archives", F.lit(c)).cast("int").alias(str(c))
                                for c in codes])


def feature_vectors(items: DataFrame, codes: Sequence, out_col: str = "features",
                    keep: Sequence[str] | None = None) -> DataFrame:
    """Add a sparse 0/1 vector over ``codes`` (M4), keeping ``keep`` columns (default all).

    One expression whatever the number of codes: the itemset is looked up in
    a vocabulary of the codes as text.
    """
    keep = list(items.columns if keep is None else keep)
    model = CountVectorizerModel.from_vocabulary([str(c) for c in codes], "_codes", out_col).setBinary(True)
    return model.transform(items.withColumn("_codes", F.col("archives").cast("array<string>"))).select(*keep, out_col)


def dictionary_vectors(members: DataFrame, dictionary: DataFrame, out_col: str = "features") -> DataFrame:
    """(id, vector): the sparse 0/1 vector of every subject over a distributed dictionary (M4).

    ``members`` has (id, archive), ``dictionary`` (archive, place) from
    ``code_dictionary``; only the number of codes comes to the driver. The
    places join on the code, after repeated memberships are combined
    map-side, and are gathered by subject. A sparse vector is stored as a
    struct of its kind, size, places and values, so the rows are written as
    such structs and read as vectors: no Python works on a row. Codes that
    the dictionary lacks have no component; a subject with none of them
    keeps an empty vector.
    """
    spark = members.sparkSession
    size = dictionary.count()
    placed = members.select("id", "archive").distinct().join(dictionary, "archive", "left")
    rows = placed.groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("_at")).select(
        "id", F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("_at").alias("indices"),
                       F.transform("_at", lambda _: F.lit(1.0)).alias("values")).alias(out_col))
    path = scratch_folder(spark, "vectors")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(StructType([rows.schema["id"], StructField(out_col, VectorUDT())])).parquet(path)


def choose_components(cumulative: Sequence[float], low: float, high: float) -> int:
    """Number of components by the reference's bisection on k (M6, Q5).

    ``cumulative[k-1]`` is the variance explained by the first k components.
    Bisection between 1 and the number of codes; a k inside [low, high]
    wins; if none is met the last k tried is kept; a single code gives 1.
    """
    lower, upper = 1, len(cumulative)
    tried = 1
    while lower < upper:
        mid = (lower + upper) >> 1
        tried = mid
        v = cumulative[mid - 1]
        if v < low:
            lower = mid + 1
        elif v > high:
            upper = mid
        else:
            return mid
    return tried


@dataclass
class PcaSelection:
    """A full-rank PCA fit and the number ``k`` of leading components kept.

    MLlib's PCA eigendecomposes the whole covariance whatever its k and a
    k-component model holds the first k columns of it, so the full fit
    serves every k: one pass over the data instead of one per k tried. The
    sign of a component is fixed: its largest absolute loading (the first of
    equals) is positive.
    """
    full: PCAModel
    k: int

    @property
    def signs(self) -> np.ndarray:
        """1 or -1 per component of the full fit."""
        pc = self.full.pc.toArray()
        # rounded, so that equal loadings count as equal
        return np.where(pc[np.abs(pc.round(9)).argmax(axis=0), range(pc.shape[1])] < 0, -1.0, 1.0)

    @property
    def pc(self) -> np.ndarray:
        """Loadings, codes x k."""
        return (self.full.pc.toArray() * self.signs)[:, : self.k]

    def whole(self) -> PcaSelection:
        """The same fit with all its components."""
        return PcaSelection(self.full, self.full.pc.numCols)

    @property
    def explained(self) -> np.ndarray:
        return self.full.explainedVariance.toArray()[: self.k]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the k-component projection (not centred, as MLlib projects)."""
        out = self.full.getOutputCol()
        signed = ElementwiseProduct(scalingVec=Vectors.dense(self.signs), inputCol="_pca", outputCol=out)
        projected = signed.transform(self.full.transform(df).withColumnRenamed(out, "_pca")).drop("_pca")
        if self.k == self.full.pc.numCols:
            return projected
        return projected.withColumn(out, array_to_vector(F.slice(vector_to_array(out), 1, self.k)))


def pca_select(features: DataFrame, low: float, high: float, col: str = "features",
               out_col: str = "pca_features", size: int | None = None) -> PcaSelection:
    """PCA whose component count explains a variance share in [low, high] (M5, M6).

    One full-rank fit gives every component's explained variance; the
    reference's bisection on k is replayed on its prefix sums.
    """
    n = size if size is not None else len(features.select(col).first()[0])
    full = PCA(k=n, inputCol=col, outputCol=out_col).fit(features)
    cum = np.cumsum(full.explainedVariance.toArray()).tolist()
    return PcaSelection(full, choose_components(cum, low, high))


def weighted_pca(sets: DataFrame, codes: Sequence, low: float, high: float, out_col: str = "pca_features") -> PcaSelection:
    """``pca_select`` over one 0/1 vector per subject, from (archives, weight): distinct itemsets with their subjects.

    MLlib's PCA takes no weights, but depends on the rows only through their
    covariance. How many subjects hold each pair of codes gives it exactly,
    in whole numbers, from the distinct itemsets alone; like in MLlib the
    codes x codes matrix comes to the driver. MLlib then fits rows that have
    this covariance: plus and minus its factor's.
    """
    spark, place = sets.sparkSession, {c: i for i, c in enumerate(codes)}
    total = sets.agg(F.sum("weight")).first()[0] or 0
    if total < 2:
        return pca_select(feature_vectors(sets.select("archives"), codes), low, high, out_col=out_col, size=len(codes))
    both = np.zeros((len(codes), len(codes)))
    pairs = sets.select("archives", "weight", F.explode("archives").alias("a")).select("a", F.explode("archives").alias("b"), "weight")
    for a, b, n in pairs.groupBy("a", "b").agg(F.sum("weight")).collect():
        both[place[a], place[b]] = n
    held = np.diagonal(both)
    size, axes = np.linalg.eigh((both - np.outer(held, held) / total) / (total - 1))
    factor = (axes * np.sqrt(np.maximum(size, 0.0))).T
    rows = spark.createDataFrame([(Vectors.dense(r),) for r in [*factor, *-factor]], ["features"])
    return pca_select(rows, low, high, out_col=out_col, size=len(codes))


def top_loadings(spark: SparkSession, model: PcaSelection, codes: Sequence, registry: DataFrame,
                 n: int) -> DataFrame:
    """(archive, pc, loading, archive_description): top ``n`` codes per component (M7).

    The loadings matrix (codes x k, model data) becomes a wide frame, is
    melted, ranked by absolute loading (code breaks ties), rounded to 5
    digits and described.
    """
    pc = model.pc
    k = pc.shape[1]
    pcs = [str(j) for j in range(k)]
    wide = spark.createDataFrame([(c, *[float(x) for x in row]) for c, row in zip(codes, pc.tolist())],
                                 ["archive", *pcs])
    out = loadings_report(wide, pcs, registry, n)
    return out.select("archive", F.col("pc").cast("int").alias("pc"), "loading", "archive_description")


def loadings_report(wide: DataFrame, pcs: Sequence[str], registry: DataFrame, n: int) -> DataFrame:
    """Melt a code x component frame and keep the top ``n`` per component."""
    long = melt(wide, ["archive"], pcs, "pc", "loading").filter(F.col("loading").isNotNull())
    top = top_n_by(long, ["pc"], [F.abs("loading").desc(), F.asc("archive")], n)
    return describe_code(top.withColumn("loading", F.round("loading", 5)), registry)


def explained_variance(spark: SparkSession, model: PcaSelection) -> DataFrame:
    """(pc, explained_variance) per kept component, 3 digits (M8)."""
    rows = [(i, round(float(v), 3)) for i, v in enumerate(model.explained)]
    return spark.createDataFrame(rows, "pc int, explained_variance double")
