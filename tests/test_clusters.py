import itertools

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from setscope.operators.clusters import set_entries, wcss, weighted_silhouette
from setscope.operators.diameter import itemset_diameter, vector_diameter
from setscope.operators.features import feature_vectors
from setscope.plans.analysis import build_analysis
from setscope.sources import bindings as B
from setscope.sources.memberships import code_domain, itemsets


def _weighted(items_with_cluster):
    return (items_with_cluster.groupBy("archives", "cluster").agg(F.count("*").alias("weight"))
            .withColumn("entries", set_entries("archives")))


def test_weighted_silhouette_equals_subject_level_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator

    m, _ = B.order_parttype(spark, SF_SMALL)
    it = itemsets(m).join(B.order_rule_clusters(spark, SF_SMALL, "B2"), "id")
    ref = ClusteringEvaluator(predictionCol="cluster").evaluate(feature_vectors(it, code_domain(m)))
    pts = _weighted(it)
    got = weighted_silhouette(pts).first().score
    keyed = weighted_silhouette(pts.withColumn("g", F.lit(1)), by=["g"]).first().score
    assert abs(keyed - got) < 1e-12
    assert abs(got - ref) < 1e-12


def test_silhouette_singleton_cluster_is_zero(spark):
    it = spark.createDataFrame([([1], 0), ([1, 2], 0), ([3], 1)], "archives array<int>, cluster int")
    pts = _weighted(it)
    # point [3] is alone: silhouette 0; the other two compare to it
    score = weighted_silhouette(pts).first().score
    x = {"a": np.array([1, 0, 0]), "b": np.array([1, 1, 0]), "c": np.array([0, 0, 1])}
    d = lambda u, v: float(((x[u] - x[v]) ** 2).sum())
    s_a = (d("a", "c") - d("a", "b")) / max(d("a", "c"), d("a", "b"))
    s_b = (d("b", "c") - d("a", "b")) / max(d("b", "c"), d("a", "b"))
    assert abs(score - (s_a + s_b + 0) / 3) < 1e-12


def test_wcss_matches_numpy(spark):
    m, _ = B.order_parttype(spark, SF_SMALL)
    it = itemsets(m).join(B.order_rule_clusters(spark, SF_SMALL, "B2"), "id")
    codes = code_domain(m)
    got = {r.cluster: r for r in wcss(_weighted(it)).collect()}
    rows = it.select("cluster", "archives").collect()
    for c in got:
        X = np.array([[1.0 if k in r.archives else 0.0 for k in codes] for r in rows if r.cluster == c])
        assert abs(got[c].wcss - ((X - X.mean(0)) ** 2).sum()) < 1e-6 and got[c].size == len(X)


def _brute_sets(rows):
    out = {}
    for c, grp in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        sets = {frozenset(s) for _, s in grp}
        best = max((len(a ^ b) for a, b in itertools.combinations(sets, 2)), default=0)
        out[c] = best ** 0.5
    return out


def test_itemset_diameter_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for c in range(4):
        size = [1, 40, 120, 300][c]
        for _ in range(size):
            k = int(rng.integers(1, 6))
            rows.append((c, tuple(sorted(set(int(v) for v in rng.integers(0, 12, size=k))))))
    rows.append((4, (1, 2)))  # a cluster of one distinct point
    rows.append((4, (1, 2)))
    df = spark.createDataFrame([(c, list(s)) for c, s in rows], "cluster int, archives array<int>")
    got = {r.cluster: r.value for r in itemset_diameter(df, ["cluster"]).collect()}
    ref = _brute_sets(rows)
    assert got.keys() == ref.keys()
    for c in ref:
        assert abs(got[c] - ref[c]) < 1e-12, (c, got[c], ref[c])


def test_vector_diameter_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(int(c), rng.normal(size=6).tolist()) for c in rng.integers(0, 3, size=90)]
    pts.append((7, [0.0] * 6))
    df = spark.createDataFrame(pts, "cluster int, v array<double>").select("cluster", array_to_vector("v").alias("features"))
    got = {r.cluster: r.value for r in vector_diameter(df, ["cluster"]).collect()}
    for c in set(p[0] for p in pts):
        X = np.array([p[1] for p in pts if p[0] == c])
        ref = max((np.linalg.norm(a - b) for a, b in itertools.combinations(X, 2)), default=0.0)
        assert abs(got[c] - ref) < 1e-9


def test_wcss_on_dense_vectors_matches_numpy(spark):
    pts = B.embedding_points(spark, SF_SMALL)
    numbered = F.transform(vector_to_array("features"), lambda v, i: F.struct(i.alias("dim"), v.alias("value")))
    got = {r.cluster: r.wcss for r in wcss(pts.select(
        "cluster", F.lit(1).alias("weight"), numbered.alias("entries"))).collect()}
    rows = pts.collect()
    for c, value in got.items():
        X = np.array([r.features.toArray() for r in rows if r.cluster == c])
        assert abs(value - ((X - X.mean(0)) ** 2).sum()) < 1e-6 * max(1.0, value)


def test_itemsets_of_more_than_64_codes_and_hot_cluster(spark):
    rng = np.random.default_rng(3)
    rows = [(0 if i < 300 else 1, tuple(sorted(set(int(v) for v in rng.integers(0, 150, size=int(rng.integers(1, 9)))))))
            for i in range(330)]
    df = spark.createDataFrame([(c, list(s)) for c, s in rows], "cluster int, archives array<int>")
    got = {r.cluster: r.value for r in itemset_diameter(df, ["cluster"]).collect()}
    ref = _brute_sets(rows)
    assert all(abs(got[c] - ref[c]) < 1e-12 for c in ref)


def test_pairs_of_a_hot_cluster_are_spread_over_block_pairs(spark):
    """One cluster of all points: the pair join has a key for every pair of blocks."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(0, rng.normal(size=8).tolist()) for _ in range(400)], "cluster int, features array<double>")
    out = vector_diameter(df, ["cluster"])
    X = np.array([r.features for r in df.collect()])
    assert abs(out.first().value - max(np.linalg.norm(X - x, axis=1).max() for x in X)) < 1e-9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_x" in plan and "_y" in plan


def test_assigned_runs_all_models_in_one_pass(spark):
    from setscope.operators.batch_kmeans import assign
    from setscope.plans.explore import assigned, exploded, fit_models

    m, _ = B.order_nation(spark, SF_SMALL)
    an = build_analysis(m)
    models = fit_models(an, {"raw": [2, 3], "pca": [4]}, seed=1)
    wide = assigned(an, models, ("analysis_type", "k"))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "Union" not in plan
    got = {(r.analysis_type, r.k, tuple(r.archives)): r.prediction for r in exploded(wide).collect()}
    for key, model in models.items():
        for r in assign(an.base, [model]).collect():
            assert got[*key, tuple(r.archives)] == r.labels[0]
    an.release()


def test_vector_pairs_in_several_blocks_equal_brute_force(spark, monkeypatch):
    """Blocks of a few points, pairs in small pieces, far from the origin and with equal distances."""
    from setscope.operators import diameter as D

    monkeypatch.setattr(D, "BLOCK_BYTES", 1024)
    rng = np.random.default_rng(21)
    pts = [(c, (v + 1e4 * c).tolist()) for c in (0, 1) for v in rng.normal(size=(90, 8))]
    pts += [(2, np.eye(8)[i % 8].tolist()) for i in range(20)] + [(3, [0.0] * 8)]
    pts += [(None, [1.0] * 8), (0, None), (0, [None] * 8)]
    out = D.vector_diameter(spark.createDataFrame(pts, "cluster int, features array<double>"), ["cluster"])
    # the vectors of a cluster meet as blocks, not as rows of a join
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.cluster: r.value for r in out.collect()}
    for c in range(4):
        X = np.array([v for k, v in pts if k == c and v and None not in v])
        assert abs(got[c] - max(np.linalg.norm(X - x, axis=1).max() for x in X)) < 1e-9


def test_farthest_pair_measures_what_rounding_leaves_in_question(monkeypatch):
    from setscope.operators import diameter as D

    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 256)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(70, 5)) + 1e6, rng.normal(size=(50, 5)) + 1e6
    b[7:30] = b[7]
    want = max(sum((x - y)**2 for x, y in zip(p, q)) for p in a.tolist() for q in b.tolist())
    assert D.farthest_pair(a, b) == want
    assert D.farthest_pair(a[:0], b) == D.farthest_pair(a, b[:0]) == 0.0
