"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator group.

Each reads the whole test tables through a binding (see sources.bindings)
and runs the library's operators; the SQL twins live in ``oracles.py``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.arrays import array_text
from setscope.options import Options
from setscope.sources import bindings as B
from setscope.sources.memberships import code_dictionary, code_domain, itemsets, run_stats, sample_rows, subjects
from setscope.operators import mining
from setscope.operators.clusters import set_entries, wcss, weighted_silhouette
from setscope.operators.describe import describe_code, segment_rows, tag
from setscope.operators.diameter import itemset_diameter, vector_diameter
from setscope.operators.features import loadings_report, one_hot
from setscope.operators.profiles import (
    code_frequencies, itemset_counts, itemset_occurrences, top_itemsets, trend_itemsets)
from setscope.operators.reshape import relabel, union_tagged
from setscope.session import ensure_checkpoint_dir, materialize, release_tables, scratch_folder, tables_of
from setscope.sources.buckets import read_store, upsert_store
from setscope.sources.results import read_result, write_result
from setscope.sources.tables import test_table

OPTS = Options()

# Fitted models and analysis frames are kept per Spark application and input,
# so tasks that share a model (elbow, silhouette and diameter of one sweep;
# the three rule reports) fit it once, as the reference job does per process.
# Keys are explicit (application, input folder, parameters), never frames.
_MEMO: dict = {}
_LOCKS: dict = {}
_GUARD = threading.Lock()
MEMO_TABLES = "registered queries"


def _memo(spark: SparkSession, key: tuple, build):
    """The value for ``key``, built once even when several threads ask for it."""
    k = (spark.sparkContext.applicationId, *key)
    with _GUARD:
        lock = _LOCKS.setdefault(k, threading.Lock())
    with lock, tables_of(MEMO_TABLES):
        if k not in _MEMO:
            _MEMO[k] = build()
    return _MEMO[k]


def release_memo(spark: SparkSession) -> None:
    """Forget the kept values of this application, with the tables they read."""
    app = spark.sparkContext.applicationId
    for k in [k for k in _MEMO if k[0] == app]:
        del _MEMO[k]
    release_tables(spark, MEMO_TABLES)


# Thresholds of the registered rule queries: the reference defaults on B2.
RULES_SUPPORT = OPTS.min_support
RULES_CONFIDENCE = OPTS.min_confidence


def q_memberships(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_nation(spark, sf)
    return m


def q_registry_first_description(spark: SparkSession, sf: str) -> DataFrame:
    return B.part_type_registry(spark, sf)


def q_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_nation(spark, sf)
    it = itemsets(m)
    return it.select("id", array_text("archives").alias("archives"),
                     F.size("archives").cast("int").alias("n_codes"))


def q_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Per subject: sorted codes and how many membership rows each code has."""
    m, _ = B.order_nation(spark, sf)
    return subjects(m).select("id", array_text("archives").alias("archives"),
                              array_text("occurrences").alias("occurrences"))


def q_describe_code(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar code lookup: every membership row with its nation name (left join)."""
    m, reg = B.order_nation(spark, sf)
    return describe_code(m, reg)


def q_sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_parttype(spark, sf)
    return sample_rows(m, OPTS.sample_fraction, seed=7, keys=["id", "archive"])


def q_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_nation(spark, sf)
    return run_stats(m)


def _rules(spark: SparkSession, sf: str, report: str) -> DataFrame:
    m, reg = B.order_parttype(spark, sf)
    # every distinct itemset once with its subjects, written once and shared by the reports
    items = _memo(spark, ("rule itemsets", sf), lambda: materialize(mining.weighted_itemsets(itemsets(m)), "weighted-itemsets"))
    model = _memo(spark, ("rules", sf, RULES_SUPPORT, RULES_CONFIDENCE),
                  lambda: mining.mine(items, RULES_SUPPORT, RULES_CONFIDENCE))
    return mining.rules_report(items, reg, model=model, reports=[report])[report]


def q_frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    return _rules(spark, sf, "frequencies")


def q_association_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rules(spark, sf, "confidences")


def q_predict_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _rules(spark, sf, "predictions")


def q_code_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_nation(spark, sf)
    assign = B.order_rule_clusters(spark, sf, "B1")
    return tag(code_frequencies(m, assign), analysis_type="raw", model_type="rule")


def _counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m, reg = B.order_nation(spark, sf)
    return itemset_counts(itemsets(m), B.order_rule_clusters(spark, sf, "B1")), reg


def q_itemset_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    counts, _ = _counts(spark, sf)
    occ = itemset_occurrences(counts, OPTS.top_itemsets)
    return tag(occ.withColumn("archives", array_text("archives")),
               analysis_type="raw", model_type="rule")


def q_trend_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    counts, reg = _counts(spark, sf)
    return tag(trend_itemsets(top_itemsets(counts, OPTS.top_itemsets), reg).withColumn("archives", array_text("archives")),
               analysis_type="raw", model_type="rule")


def q_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_parttype(spark, sf)
    return one_hot(itemsets(m), code_domain(m))


def q_melt_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """Code x brand matrix (mean part size minus 25.5) melted, top 3 per brand by |value|."""
    part = test_table(spark, sf, "part").filter(F.col("p_type").isNotNull() & F.col("p_brand").isNotNull())
    brands = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]
    wide = (part.groupBy(F.col("p_type").alias("archive")).pivot("p_brand", brands)
            .agg(F.avg("p_size") - F.lit(25.5)))
    return loadings_report(wide, brands, B.part_type_registry(spark, sf), 3)


def q_relabel(spark: SparkSession, sf: str) -> DataFrame:
    assign = B.order_rule_clusters(spark, sf, "B1", n=6).withColumnRenamed("cluster", "prediction")
    mapping = (assign.select("prediction").distinct()
               .withColumn("hier_prediction", (F.col("prediction") % 2 + 1).cast("int")))
    return relabel(assign, mapping)


def _b2_points(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (itemset, cluster) points of B2 weighted by their subjects (equal to the subject-level values)."""
    m, _ = B.order_parttype(spark, sf)
    assigned = itemsets(m).join(B.order_rule_clusters(spark, sf, "B2"), "id")
    return (assigned.groupBy("archives", "cluster").agg(F.count(F.lit(1)).alias("weight"))
            .withColumn("entries", set_entries("archives")))


def q_wcss(spark: SparkSession, sf: str) -> DataFrame:
    out = wcss(_b2_points(spark, sf))
    return out.select("cluster", F.col("size").cast("int").alias("size"), F.round("wcss", 6).alias("wcss"))


def q_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouette of the given clusters over the weighted points."""
    points = materialize(_b2_points(spark, sf), "silhouette-points")
    return weighted_silhouette(points).select(F.round("score", 6).alias("score"))


def q_cluster_diameter(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_nation(spark, sf)
    assigned = itemsets(m).join(B.order_rule_clusters(spark, sf, "B1"), "id")
    return itemset_diameter(assigned, ["cluster"]).withColumn("value", F.round("value", 6))


def q_cluster_diameter_vectors(spark: SparkSession, sf: str) -> DataFrame:
    pts = B.embedding_points(spark, sf)
    return vector_diameter(pts, ["cluster"]).withColumn("value", F.round("value", 6))


def q_segment_text(spark: SparkSession, sf: str) -> DataFrame:
    return segment_rows(B.document_texts(spark, sf), "doc_id", "text", OPTS.segment_length)


def q_upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A store of all orders, then a tenth of them changed, all customers as new keys, and a further column."""
    orders, customer = test_table(spark, sf, "orders"), test_table(spark, sf, "customer")
    path = scratch_folder(spark, "store")
    kept = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_totalprice").alias("amount"))
    upsert_store(spark, kept, path, ["key"])
    changed = orders.where(F.col("o_orderkey") % 10 == 3).select(
        F.col("o_orderkey").alias("key"), F.lit("changed").alias("value"), F.col("o_orderpriority").alias("note"))
    new = customer.select((-F.col("c_custkey") - 1).alias("key"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("note"))
    upsert_store(spark, changed.unionByName(new), path, ["key"])
    return read_store(spark, path)


def q_orc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    import uuid
    path = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}/archives_frequencies"
    write_result(q_code_frequencies(spark, sf), path, partition_by=("model_type", "analysis_type"))
    return read_result(spark, path)


def q_union_tagged(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = B.order_nation(spark, sf)
    parts = [({"analysis_type": "raw", "model_type": "rule"},
              code_frequencies(m, B.order_rule_clusters(spark, sf, "B1", n=3))),
             ({"analysis_type": "pca", "model_type": "rule"},
              code_frequencies(m, B.order_rule_clusters(spark, sf, "B1", n=5)))]
    return union_tagged(parts)


# Model-based queries run the whole default sweeps (k 5..45, K 100, t 5..25, k 30/38) for raw and pca.
TYPES = ("raw", "pca")


def _analysis(spark: SparkSession, sf: str):
    from setscope.plans.analysis import build_analysis
    m, reg = B.order_nation(spark, sf)
    return _memo(spark, ("analysis", sf), lambda: build_analysis(m, OPTS)), reg


def _fits(spark: SparkSession, sf: str, ks: dict) -> dict:
    """Models by (analysis type, k): those not known yet are fitted together."""
    from setscope.plans.explore import fit_models
    an, _ = _analysis(spark, sf)
    known = _memo(spark, ("kmeans", sf, OPTS.seed), dict)
    with _memo(spark, ("kmeans lock", sf), threading.Lock):
        todo = {t: [k for k in own if (t, k) not in known] for t, own in ks.items()}
        if any(todo.values()):
            known |= fit_models(an, todo, OPTS.seed)
    return {(t, k): known[t, k] for t, own in ks.items() for k in own}


def _big(spark: SparkSession, sf: str) -> dict:
    return {t: m for (t, _), m in _fits(spark, sf, {t: [OPTS.big_k] for t in TYPES}).items()}


def _trees(spark: SparkSession, sf: str):
    from setscope.plans.explore import linkage_of
    return _memo(spark, ("trees", sf, OPTS.big_k, OPTS.seed), lambda: linkage_of(spark, _big(spark, sf)))


def q_top_pcs(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import top_pcs
    an, reg = _analysis(spark, sf)
    return top_pcs(spark, an, reg, OPTS.n_loadings)


def q_pc_explained_variance(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import pc_explained_variance
    an, _ = _analysis(spark, sf)
    return pc_explained_variance(spark, an)


def _sweep(spark: SparkSession, sf: str):
    from setscope.plans.explore import assigned
    an, _ = _analysis(spark, sf)
    fits = _fits(spark, sf, {t: OPTS.k_values for t in TYPES})
    # every itemset once with its cluster under all models, written once and shared by the metrics
    wide = _memo(spark, ("sweep", sf), lambda: materialize(assigned(an, fits, ("analysis_type", "k")), "sweep"))
    return an, fits, wide


def q_elbow(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import elbow_report
    an, _ = _analysis(spark, sf)
    return elbow_report(an, _fits(spark, sf, {t: OPTS.k_values for t in TYPES}))


def q_silhouette_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import silhouette_report
    an, fits, wide = _sweep(spark, sf)
    return silhouette_report(an, wide, fits)


def q_diameter_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import diameter_report, exploded
    an, _, wide = _sweep(spark, sf)
    return diameter_report(exploded(wide), "kmeans", an.codes)


def q_sweep_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects and code memberships that the clusters of every k-means model hold together."""
    from setscope.plans.explore import exploded
    preds = exploded(_sweep(spark, sf)[2])
    return preds.groupBy("analysis_type", F.col("k").alias("cluster")).agg(
        F.sum("weight").alias("subjects"), F.sum(F.col("weight") * F.size("archives")).alias("memberships"),
        (F.min("prediction") >= 0).alias("from_zero"), (F.max("prediction") < F.max("k")).alias("below_k"))


def q_elbow_error(spark: SparkSession, sf: str) -> DataFrame:
    """No raw model's cost lies below the wcss of its assignments (its centres may have a step to go) or above one cluster's."""
    from setscope.plans.explore import elbow_report, exploded
    an, fits, wide = _sweep(spark, sf)
    preds = exploded(wide)
    costs = elbow_report(an, {key: m for key, m in fits.items() if key[0] == "raw"})
    own = wcss(preds.filter("analysis_type = 'raw'").select(
        "k", "weight", F.col("prediction").alias("cluster"), set_entries("archives").alias("entries")), by=["k"])
    total = own.groupBy(F.col("k").alias("cluster")).agg(F.sum("wcss").alias("wcss"))
    one = wcss(preds.filter(f"analysis_type = 'raw' and k = {OPTS.k_low}").select(
        "weight", F.lit(0).alias("cluster"), set_entries("archives").alias("entries")))
    return (costs.join(total, "cluster").join(one.select(F.col("wcss").alias("all"), F.explode(
        F.array(*map(F.lit, OPTS.k_values))).alias("cluster")), "cluster")
        .select("cluster", F.round("all", 4).alias("one_cluster"),
                (F.col("cost") >= F.col("wcss") - 1e-9 * F.col("all")).alias("not_below_wcss"),
                (F.col("cost") <= F.col("all")).alias("below_one_cluster")))


# numbers of clusters and steps of the fits that SQL repeats, and of centres taken from the itemsets
STEP_KS, STEPS, GIVEN_K, TREE_K, TREE_TS = (5, 12, 25), 3, 80, 25, (5, 10, 20)


def _itemset_weights(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    from setscope.plans.analysis import held_codes, itemset_base
    m, _ = B.order_nation(spark, sf)

    def build():
        weights = materialize(itemset_base(subjects(m))[0], "weights")
        return weights, held_codes(weights)

    return _memo(spark, ("weights", sf), build)


def _few_steps(spark: SparkSession, sf: str):
    from setscope.operators.batch_kmeans import fit
    points, codes = _itemset_weights(spark, sf)
    return points, fit(points, codes, {(k,): (k, None) for k in STEP_KS}, STEPS, seed=OPTS.seed)


def q_kmeans_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster of every distinct itemset after three Lloyd steps, for several k at once."""
    from setscope.operators.batch_kmeans import assign
    points, models = _few_steps(spark, sf)
    return assign(points, list(models.values())).select(
        array_text("archives").alias("archives"), "weight", F.explode(F.arrays_zip(
            F.array(*map(F.lit, STEP_KS)).alias("k"), F.col("labels").alias("prediction"))).alias("_a")).select(
        "archives", "weight", "_a.k", "_a.prediction")


def q_kmeans_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of the same models: weighted squared distances to their centres."""
    from setscope.operators.batch_kmeans import costs
    points, models = _few_steps(spark, sf)
    return costs(points, list(models.values())).select(
        F.element_at(F.array(*map(F.lit, STEP_KS)), F.col("model") + 1).alias("cluster"), F.round("cost", 6).alias("cost"))


def _given(spark: SparkSession, sf: str, k: int):
    """The first k distinct itemsets in hash order as centres."""
    import numpy as np
    from setscope.operators.batch_kmeans import Model, seeds
    points, codes = _itemset_weights(spark, sf)
    rows = seeds(points, k, codes, None, OPTS.seed)
    return points, Model(("given",), codes, rows, np.ones(len(rows), dtype=np.int64))


def q_assign_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest of 80 given itemsets for every distinct itemset, with pruning."""
    from setscope.operators.batch_kmeans import assign
    points, model = _given(spark, sf, GIVEN_K)
    return assign(points, [model]).select(array_text("archives").alias("archives"), F.col("labels")[0].alias("prediction"))


def q_two_stage_given(spark: SparkSession, sf: str) -> DataFrame:
    """Flat group of every distinct itemset: nearest of 25 given itemsets, their complete linkage, its cuts.

    A last coordinate, a thousandth of the logarithm of a centre's number, keeps the heights apart."""
    import numpy as np
    from setscope.operators.batch_kmeans import assign
    from setscope.operators.linkage import centroid_frame, complete_linkage, cut_trees
    points, model = _given(spark, sf, TREE_K)
    number = np.log(np.arange(model.k) + 2.0)[:, None] / 1000
    merges = materialize(complete_linkage(centroid_frame(spark, np.hstack((model.centres(), number))), model.k), "given-merges")
    labels = assign(points, [model]).select("archives", F.col("labels")[0].alias("node"))
    return labels.join(cut_trees(merges, model.k, TREE_TS), "node").select(
        "t", array_text("archives").alias("archives"), F.col("cluster").alias("prediction"))


def q_silhouette_given(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouettes of three clusterings by rules on the itemset, at once."""
    from setscope.operators.batch_kmeans import silhouettes
    points, codes = _itemset_weights(spark, sf)
    size, first, last = F.size("archives"), F.col("archives")[0], F.element_at("archives", -1)
    labels = F.array((size % 3).cast("int"), (first % 4).cast("int"), ((first + last) % 7).cast("int"))
    return silhouettes(points.withColumn("labels", labels), [3, 4, 7], codes).select("model", F.round("score", 6).alias("score"))


def q_tree_diameters(spark: SparkSession, sf: str) -> DataFrame:
    """Diameter of every flat group of the nations' tree at every t: an itemset lies in the leaf of its smallest code."""
    from setscope.operators.linkage import cut_trees, tree_members
    from setscope.operators.tree_diameter import tree_diameters
    merges, n = _nation_merges(spark, sf)
    points, codes = _itemset_weights(spark, sf)
    members = materialize(tree_members(merges, n), "members")
    cuts = materialize(cut_trees(merges, n, OPTS.t_values, members=members), "cuts")
    return tree_diameters(points.withColumn("leaf", F.col("archives")[0].cast("int")), merges, members, cuts, codes).select(
        "t", "cluster", F.round("value", 6).alias("value"))


def q_linkage(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import dendrogram_report
    return dendrogram_report(_trees(spark, sf))[0]


def q_leaf_order(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import dendrogram_report
    return dendrogram_report(_trees(spark, sf))[1]


def q_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import hierarchical_predictions
    an, _ = _analysis(spark, sf)
    pred = hierarchical_predictions(an, _big(spark, sf), _trees(spark, sf), sorted({OPTS.opt_t_raw, OPTS.opt_t_pca}))
    return pred.select("t", "analysis_type", array_text("archives").alias("archives"), "weight", "prediction")


def q_two_stage_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects, memberships and whether the groups are numbered 1..c with c <= t, for every cut of every tree."""
    from setscope.plans.explore import hierarchical_predictions
    an, _ = _analysis(spark, sf)
    pred = hierarchical_predictions(an, _big(spark, sf), _trees(spark, sf), OPTS.t_values)
    return pred.groupBy("analysis_type", "t").agg(
        F.sum("weight").alias("subjects"), F.sum(F.col("weight") * F.size("archives")).alias("memberships"),
        ((F.min("prediction") >= 1) & (F.max("prediction") <= F.max("t"))).alias("numbered"))


def q_hier_diameter_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.plans.explore import hierarchical_diameters
    an, _ = _analysis(spark, sf)
    return hierarchical_diameters(an, _big(spark, sf), _trees(spark, sf), OPTS.t_values)


def _nation_points(spark: SparkSession, sf: str) -> DataFrame:
    """(node, vector): per nation its suppliers' number and balance, its region and the logarithm of its key,
    which keeps distances apart where there are no suppliers."""
    nation, supplier = test_table(spark, sf, "nation"), test_table(spark, sf, "supplier")
    own = supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                              F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("cents"))
    return nation.join(own, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        F.col("n_nationkey").cast("int").alias("node"),
        F.array(F.coalesce("n", F.lit(0.0)), F.coalesce(F.col("cents") / 1e6, F.lit(0.0)),
                F.col("n_regionkey").cast("double"), F.log(F.col("n_nationkey") + F.lit(2.0))).alias("vector"))


def _nation_merges(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    from setscope.operators.linkage import complete_linkage

    def build():
        points = _nation_points(spark, sf)
        n = points.count()
        return materialize(complete_linkage(points, n), "nation-merges"), n

    return _memo(spark, ("nation-linkage", sf), build)


def q_linkage_nations(spark: SparkSession, sf: str) -> DataFrame:
    """Complete linkage of the nations by their suppliers."""
    merges, _ = _nation_merges(spark, sf)
    return merges.withColumn("height", F.round("height", 6))


def q_cut_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Flat groups of the nations' tree at every t of the default range."""
    from setscope.operators.linkage import cut_trees
    merges, n = _nation_merges(spark, sf)
    return cut_trees(merges, n, OPTS.t_values)


def q_leaf_order_nations(spark: SparkSession, sf: str) -> DataFrame:
    from setscope.operators.linkage import leaf_order
    return leaf_order(*_nation_merges(spark, sf))


def q_feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vector of every subject over the code domain, as text of its indicators (M4)."""
    from pyspark.ml.functions import vector_to_array

    from setscope.operators.features import dictionary_vectors
    m, _ = B.order_parttype(spark, sf)
    rows = dictionary_vectors(m, code_dictionary(m))
    return rows.select("id", array_text(F.transform(vector_to_array("features"), lambda x: x.cast("int"))).alias("features"))


def _parttype_pca(spark: SparkSession, sf: str):
    from setscope.operators.features import feature_vectors, pca_select

    def build():
        m, reg = B.order_parttype(spark, sf)
        codes = code_domain(m)
        # the whole spectrum: a band that only all components reach
        return pca_select(feature_vectors(itemsets(m), codes), 1.0 - 1e-9, 2.0, size=len(codes)), codes, reg

    return _memo(spark, ("pca-parttype", sf), build)


def q_pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Share of variance of every component of the part-type indicators (M5, M8)."""
    from setscope.operators.features import explained_variance
    return explained_variance(spark, _parttype_pca(spark, sf)[0].whole())


def q_pca_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """Described loadings of every component of the part-type indicators (M7)."""
    from setscope.operators.features import top_loadings
    model, codes, reg = _parttype_pca(spark, sf)
    return top_loadings(spark, model.whole(), codes, reg, len(codes))


def _variants(spark: SparkSession, sf: str):
    from setscope.plans.results import model_variants, profiles
    an, reg = _analysis(spark, sf)
    optimal = _fits(spark, sf, {"raw": [OPTS.opt_k_raw], "pca": [OPTS.opt_k_pca]})
    six = materialize(model_variants(an, {t: m for (t, _), m in optimal.items()}, _big(spark, sf), _trees(spark, sf),
                                     {"raw": OPTS.opt_t_raw, "pca": OPTS.opt_t_pca}), "variants")
    return profiles(an.code_counts, six, reg, OPTS.top_itemsets)


def q_variants_code_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of every code over all clusters of a variant: the same for all six."""
    freq = _memo(spark, ("variants", sf), lambda: _variants(spark, sf))["archives_frequencies"]
    return freq.groupBy("model_type", "analysis_type", "archive").agg(F.sum("archive_occurrences").alias("occurrences"))


def q_variants_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(spark, ("variants", sf), lambda: _variants(spark, sf))["archives_frequencies"]


def q_variants_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(spark, ("variants", sf), lambda: _variants(spark, sf))["archives_occurrences"]


def q_variants_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(spark, ("variants", sf), lambda: _variants(spark, sf))["trend_vector"]


def _rule_variants(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The six-variant profile path (T4 -> T1-T3 in one pass) on two clusterings
    that are rules on the itemset, so SQL can repeat them: by itemset size mod 3
    and by smallest code mod 4."""
    from setscope.plans.analysis import itemset_base
    from setscope.plans.results import cluster_variants, profiles
    m, reg = B.order_nation(spark, sf)
    weights, code_counts = itemset_base(subjects(m))
    parts = [({"model_type": "rule_size", "analysis_type": "raw"},
              weights.withColumn("cluster", (F.size("archives") % 3).cast("int"))),
             ({"model_type": "rule_first", "analysis_type": "raw"},
              weights.withColumn("cluster", (F.col("archives")[0] % 4).cast("int")))]
    return profiles(code_counts, cluster_variants(parts), reg, OPTS.top_itemsets)


def q_rule_variants_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_variants(spark, sf)["archives_frequencies"]


def q_rule_variants_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_variants(spark, sf)["archives_occurrences"]


def q_rule_variants_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_variants(spark, sf)["trend_vector"]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "memberships": q_memberships,
    "registry_first_description": q_registry_first_description,
    "itemsets": q_itemsets,
    "subjects": q_subjects,
    "describe_code": q_describe_code,
    "sample_hash": q_sample_hash,
    "run_stats": q_run_stats,
    "frequent_itemsets": q_frequent_itemsets,
    "association_rules": q_association_rules,
    "predict_missing": q_predict_missing,
    "code_frequencies": q_code_frequencies,
    "itemset_occurrences": q_itemset_occurrences,
    "trend_itemsets": q_trend_itemsets,
    "one_hot": q_one_hot,
    "melt_top_n": q_melt_top_n,
    "relabel": q_relabel,
    "wcss": q_wcss,
    "silhouette": q_silhouette,
    "cluster_diameter": q_cluster_diameter,
    "cluster_diameter_vectors": q_cluster_diameter_vectors,
    "segment_text": q_segment_text,
    "upsert_by_key": q_upsert_by_key,
    "orc_round_trip": q_orc_round_trip,
    "union_tagged": q_union_tagged,
    "rule_variants_frequencies": q_rule_variants_frequencies,
    "rule_variants_occurrences": q_rule_variants_occurrences,
    "rule_variants_trend": q_rule_variants_trend,
    "top_pcs": q_top_pcs,
    "pc_explained_variance": q_pc_explained_variance,
    "elbow": q_elbow,
    "silhouette_sweep": q_silhouette_sweep,
    "diameter_sweep": q_diameter_sweep,
    "sweep_sizes": q_sweep_sizes,
    "elbow_error": q_elbow_error,
    "linkage": q_linkage,
    "leaf_order": q_leaf_order,
    "two_stage": q_two_stage,
    "hier_diameter_sweep": q_hier_diameter_sweep,
    "variants_frequencies": q_variants_frequencies,
    "variants_occurrences": q_variants_occurrences,
    "variants_trend": q_variants_trend,
    "variants_code_totals": q_variants_code_totals,
    "two_stage_sizes": q_two_stage_sizes,
    "linkage_nations": q_linkage_nations,
    "cut_tree": q_cut_tree,
    "leaf_order_nations": q_leaf_order_nations,
    "feature_vectors": q_feature_vectors,
    "pca_variance": q_pca_variance,
    "pca_loadings": q_pca_loadings,
    "kmeans_steps": q_kmeans_steps,
    "kmeans_costs": q_kmeans_costs,
    "assign_nearest": q_assign_nearest,
    "two_stage_given": q_two_stage_given,
    "silhouette_given": q_silhouette_given,
    "tree_diameters": q_tree_diameters,
}
