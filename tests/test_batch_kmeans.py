import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setscope.operators import batch_kmeans as K
from setscope.operators.clusters import set_entries, weighted_silhouette
from setscope.operators.linkage import complete_linkage, cut_trees, tree_members
from setscope.operators.tree_diameter import tree_diameters

CODES = [f"c{i:02d}" for i in range(14)]


def itemsets(seed, n=160, codes=CODES):
    rnd = random.Random(seed)
    sets = {tuple(sorted(rnd.sample(codes, rnd.randrange(1, 7)))) for _ in range(n)}
    return [(list(s), rnd.randrange(1, 30)) for s in sorted(sets)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "archives array<string>, weight long").repartition(parts)


def dense(rows, codes=CODES):
    return np.array([[float(c in a) for c in codes] for a, _ in rows]), np.array([float(w) for _, w in rows])


def plain_lloyd(x, w, centres, steps, project):
    y = x if project is None else x @ project
    for _ in range(steps):
        own = ((y[:, None] - centres[None])**2).sum(axis=2).round(9).argmin(axis=1)
        centres = np.array([np.average(y[own == c], axis=0, weights=w[own == c]) if (own == c).any() else centres[c]
                            for c in range(len(centres))])
    d = ((y[:, None] - centres[None])**2).sum(axis=2)
    return centres, d.round(9).argmin(axis=1), (w * d.min(axis=1)).sum()


@pytest.mark.parametrize("limit", [32 << 20, 600])
def test_models_equal_plain_loops_in_both_spaces(spark, monkeypatch, limit):
    monkeypatch.setattr(K, "GROUP_BYTES", limit)
    rows = itemsets(1)
    x, w = dense(rows)
    project = np.linalg.qr(np.random.default_rng(2).standard_normal((len(CODES), 5)))[0]
    points = frame(spark, rows)
    models = K.fit(points, CODES, {("raw", 3): (3, None), ("raw", 9): (9, None), ("pca", 6): (6, project)}, steps=4)
    first = K.seeds(points, 9, CODES).astype(float)
    labels = {tuple(r.archives): r.labels for r in K.assign(points, list(models.values())).collect()}
    cost = {r.model: r.cost for r in K.costs(points, list(models.values())).collect()}
    for i, ((kind, k), m) in enumerate(models.items()):
        loadings = project if kind == "pca" else None
        start = first[:k] if loadings is None else first[:k] @ loadings
        centres, own, total = plain_lloyd(x, w, start, 4, loadings)
        assert np.allclose(m.centres(), centres, atol=1e-9)
        assert [labels[tuple(a)][i] for a, _ in rows] == own.tolist()
        assert abs(cost[i] - total) < 1e-6 * max(total, 1)


def test_results_do_not_depend_on_partitions_and_stop_when_nothing_moves(spark):
    rows = itemsets(3)
    spec = {("raw", k): (k, None) for k in (2, 7)}
    one, two = (K.fit(frame(spark, rows, p), CODES, spec) for p in (1, 5))
    for key in spec:
        assert (one[key].sums == two[key].sums).all() and (one[key].sizes == two[key].sizes).all()
        again = K.lloyd_step(frame(spark, rows, 2), [one[key]])[0]
        assert (again.sums == one[key].sums).all()


def test_fewer_points_than_clusters(spark):
    rows = itemsets(4, 3)
    model = K.fit(frame(spark, rows), CODES, {("raw", 50): (50, None)})["raw", 50]
    assert model.k == len(rows) and K.costs(frame(spark, rows), [model]).first().cost == 0.0


def test_pruned_search_finds_the_same_centres_with_fewer_comparisons():
    rnd = np.random.default_rng(5)
    middle = (rnd.random((12, 40)) < 0.3).astype(float)
    make = lambda n: np.abs(middle[rnd.integers(0, 12, n)] - (rnd.random((n, 40)) < 0.03))
    centres, x = make(300).astype(np.int64), make(2000)
    for loadings in (None, np.linalg.qr(rnd.standard_normal((40, 8)))[0]):
        model = K.Model(("m",), list(range(40)), centres, np.ones(300, dtype=np.int64), loadings)
        search = K.Pruned(model)
        assert (search.nearest(x) == K._nearest(x, model.form(), loadings is not None)[0]).all()
        assert search.compared < 0.7 * search.all


def test_silhouettes_equal_the_single_one(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_BYTES", 500)
    rows = itemsets(6)
    points = frame(spark, rows).withColumn("labels", F.array(
        (F.size("archives") % 3).cast("int"), F.pmod(F.xxhash64("archives"), F.lit(5)).cast("int"), F.lit(0),
        F.when(F.col("weight") == 1, 1).otherwise(0)))
    got = {r.model: r.score for r in K.silhouettes(points, [3, 5, 1, 2], CODES).collect()}
    for i in range(4):
        own = points.select("weight", F.col("labels")[i].alias("cluster"), set_entries("archives").alias("entries"))
        assert abs(got[i] - weighted_silhouette(own).first().score) < 1e-9


def test_tree_diameters_equal_brute_force(spark):
    rnd = random.Random(7)
    n = 9
    nodes = spark.createDataFrame([(i, [rnd.random(), rnd.random()]) for i in range(n)], "node int, vector array<double>")
    merges = complete_linkage(nodes, n)
    members = tree_members(merges, n)
    cuts = cut_trees(merges, n, [1, 2, 4, n])
    # leaf 3 has no points, leaf 5 one point twice
    rows = [(rnd.choice([0, 1, 2, 4, 6, 7, 8]), a) for a, _ in itemsets(8, 120)] + [(5, ["c00"])] * 2
    points = spark.createDataFrame(rows, "leaf int, archives array<string>")
    got = {(r.t, r.cluster): r.value for r in tree_diameters(points, merges, members, cuts, CODES).collect()}
    flat = {}
    for r in cuts.collect():
        flat.setdefault((r.t, r.cluster), set()).add(r.node)
    want = {}
    for group, leaves in flat.items():
        sets = [frozenset(a) for leaf, a in rows if leaf in leaves]
        if sets:
            want[group] = max((len(a ^ b) for a, b in itertools.combinations(sets, 2)), default=0)**0.5
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
