"""Whole jobs: every exploration and result dataset written under one folder.

``explore`` and ``results`` compose the operators into the datasets of the
reference job (same names and columns; the dendrogram image is replaced by
the merge table and leaf order), ``save_info`` upserts the run metadata.
Tasks can be chosen by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from setscope.operators.mining import rules_report
from setscope.options import Options
from setscope.plans import explore as X
from setscope.plans.analysis import Analysis, build_analysis
from setscope.plans.info import leaf_order_rows, parameter_rows, stats_rows
from setscope.plans.results import model_variants, profiles
from setscope.sources.memberships import itemsets, sample_rows
from setscope.session import materialize, release_tables, tables_of
from setscope.sources.results import save_upsert, write_result

# fixed values: task and dataset names are the public interface of the job
EXPLORE_TASKS = ("rules", "top_pcs", "elbow", "silhouette", "distance_matrix",
                 "hierarchical_distance_matrix", "dendrogram")
RESULT_TASKS = ("archives_frequencies", "trend_vector")
TAGS = ("model_type", "analysis_type")


class Job:
    """Shares the analysis frames and fitted models between tasks of one run."""

    def __init__(self, spark: SparkSession, members: DataFrame, registry: DataFrame, out: str,
                 opts: Options = Options(), sample: float | None = None):
        """``sample`` keeps that fraction of the membership rows (P10) for the whole run; None keeps all."""
        self.spark, self.registry, self.out, self.opts = spark, registry, out, opts
        self.members = members if sample is None else sample_rows(members, sample, opts.seed, ["id", "archive"])
        self.sample_fraction = 1.0 if sample is None else sample
        self._an: Analysis | None = None
        self._models: dict = {}
        self._trees: X.Trees | None = None
        self._preds: DataFrame | None = None
        self._variant_frame: DataFrame | None = None
        self.info: list[DataFrame] = []
        self.owner = f"job {uuid.uuid4().hex}"

    @property
    def an(self) -> Analysis:
        if self._an is None:
            with tables_of(self.owner):
                self._an = build_analysis(self.members, self.opts)
            self.info.append(stats_rows(self.members))
        return self._an

    def models(self, ks: dict[str, Sequence[int]]) -> dict:
        """The models of all (analysis type, k), those not known yet fitted together; fits are kept for later tasks."""
        todo = {t: [k for k in own if (t, k) not in self._models] for t, own in ks.items()}
        if any(todo.values()):
            self._models |= X.fit_models(self.an, todo, self.opts.seed)
        return {(t, k): self._models[t, k] for t, own in ks.items() for k in own}

    def _big(self) -> dict:
        fits = self.models({t: [self.opts.big_k] for t in ("raw", "pca")})
        return {t: m for (t, _), m in fits.items()}

    @property
    def trees(self) -> X.Trees:
        if self._trees is None:
            self._trees = X.linkage_of(self.spark, self._big())
        return self._trees

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] | None = None) -> None:
        write_result(df, f"{self.out}/{name}", partition_by=partition_by)

    # --- exploration ---------------------------------------------------
    def rules(self) -> None:
        rep = rules_report(itemsets(self.members), self.registry, self.opts.min_support, self.opts.min_confidence)
        for name, df in rep.items():
            self.save(df, name)

    def top_pcs(self) -> None:
        self.save(X.top_pcs(self.spark, self.an, self.registry, self.opts.n_loadings), "top_pcs")
        self.save(X.pc_explained_variance(self.spark, self.an), "pc_explained_variance")

    def _sweep(self):
        fits = self.models({t: self.opts.k_values for t in ("raw", "pca")})
        if self._preds is None:
            # every itemset once with its cluster under all models, written once for the metric tasks
            self._preds = materialize(X.assigned(self.an, fits, ("analysis_type", "k")), "sweep")
        return fits, self._preds

    def elbow(self) -> None:
        fits = self.models({t: self.opts.k_values for t in ("raw", "pca")})
        self.save(X.elbow_report(self.an, fits), "elbow")

    def silhouette(self) -> None:
        fits, wide = self._sweep()
        self.save(X.silhouette_report(self.an, wide, fits), "silhouette")

    def distance_matrix(self) -> None:
        _, wide = self._sweep()
        self.save(X.diameter_report(X.exploded(wide), "kmeans", self.an.codes), "distance_matrix", partition_by=TAGS)

    def hierarchical_distance_matrix(self) -> None:
        found = X.hierarchical_diameters(self.an, self._big(), self.trees, self.opts.t_values)
        self.save(found, "distance_matrix", partition_by=TAGS)

    def dendrogram(self) -> None:
        merges, order = X.dendrogram_report(self.trees)
        self.save(merges, "dendrogram_merges")
        self.save(order, "dendrogram_leaf_order")
        self.info.append(leaf_order_rows(order))

    # --- results -------------------------------------------------------
    def _variants(self) -> DataFrame:
        if self._variant_frame is None:
            # six variants' assignments, written once for both result tasks
            self._variant_frame = materialize(self._build_variants(), "variants")
        return self._variant_frame

    def _build_variants(self) -> DataFrame:
        o = self.opts
        fits = self.models({"raw": [o.opt_k_raw], "pca": [o.opt_k_pca]})
        return model_variants(self.an, {t: m for (t, _), m in fits.items()}, self._big(), self.trees,
                              {"raw": o.opt_t_raw, "pca": o.opt_t_pca})

    def archives_frequencies(self) -> None:
        prof = profiles(self.an.code_counts, self._variants(), self.registry, self.opts.top_itemsets)
        self.save(prof["archives_frequencies"], "archives_frequencies", partition_by=TAGS)

    def trend_vector(self) -> None:
        prof = profiles(self.an.code_counts, self._variants(), self.registry, self.opts.top_itemsets)
        self.save(prof["archives_occurrences"], "archives_occurrences", partition_by=TAGS)
        self.save(prof["trend_vector"], "trend_vector", partition_by=TAGS)

    def run(self, tasks: Sequence[str]) -> None:
        with tables_of(self.owner):
            for t in tasks:
                getattr(self, t)()

    def save_info(self, data_table: str = "", registry_table: str = "") -> DataFrame:
        rows = [parameter_rows(self.spark, self.opts, data_table, registry_table, self.out,
                               self.sample_fraction), *self.info]
        new = rows[0]
        for r in rows[1:]:
            new = new.unionByName(r)
        return save_upsert(self.spark, new, f"{self.out}/info", ["key"], schema="key string, value string")

    def release(self) -> None:
        """Drop what the run keeps: its cached frames and its own written intermediate tables."""
        if self._an is not None:
            self._an.release()
        release_tables(self.spark, self.owner)
