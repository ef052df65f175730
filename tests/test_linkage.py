import numpy as np

import pytest

from setscope.operators.linkage import centroid_frame, complete_linkage, cut_tree, cut_trees, leaf_order, tree_members


def naive_complete(X):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    clusters = {i: [i] for i in range(n)}
    node = {i: i for i in range(n)}
    Z, nxt = [], n
    while len(clusters) > 1:
        best = None
        keys = sorted(clusters)
        for i, a in enumerate(keys):
            for b in keys[i + 1:]:
                d = max(D[p, q] for p in clusters[a] for q in clusters[b])
                if best is None or d < best[0] - 1e-12:
                    best = (d, a, b)
        d, a, b = best
        Z.append((min(node[a], node[b]), max(node[a], node[b]), d, len(clusters[a]) + len(clusters[b])))
        clusters[a] = clusters[a] + clusters.pop(b)
        node[a] = nxt
        nxt += 1
    return Z


def dfs_order(Z, n):
    def walk(v):
        if v < n:
            return [v]
        left, right = Z[v - n][0], Z[v - n][1]
        return walk(left) + walk(right)
    return walk(2 * n - 2)


def flat(Z, n, t):
    """Partition after every merge whose height is at most that of the first one leaving t groups."""
    root = list(range(2 * n - 1))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    limit = Z[n - t - 1][2] if t < n else -1
    for s, (a, b, h, _) in enumerate(Z):
        if h <= limit:
            root[find(a)] = root[find(b)] = n + s
    groups = {}
    for leaf in range(n):
        groups.setdefault(find(leaf), []).append(leaf)
    return sorted(groups.values())


def grid(n):
    """Points on a lattice: many equal distances."""
    return np.array([[i % 4, i // 4] for i in range(n)], dtype=float)


CASES = {"random60": np.random.default_rng(7).normal(size=(60, 3)), "small": np.random.default_rng(1).normal(size=(12, 3)),
         "line": np.array([[float(2**i)] for i in range(12)])}


@pytest.mark.parametrize("name", CASES)
def test_tree_cuts_and_order_match_plain_loops(spark, name):
    X = CASES[name]
    n = len(X)
    merges = complete_linkage(centroid_frame(spark, X)).cache()
    got = [(r.left, r.right, r.height, r.size) for r in merges.orderBy("step").collect()]
    ref = naive_complete(X)
    assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in ref]
    assert np.allclose([g[2] for g in got], [r[2] for r in ref])
    members = tree_members(merges, n).cache()
    order = [r.node for r in leaf_order(merges, n, members=members).orderBy("position").collect()]
    assert order == dfs_order(ref, n)
    ts = [1, 2, 3, 5, 11, n - 1, n, n + 9]
    cuts = {}
    for r in cut_trees(merges, n, ts, members=members).collect():
        cuts.setdefault(r.t, {}).setdefault(r.cluster, []).append(r.node)
    for t in ts:
        groups = [sorted(cuts[t][c]) for c in sorted(cuts[t])]
        assert groups == sorted(groups) == flat(ref, n, t)


def test_equal_distances_merge_the_closest_clusters_and_cut_to_at_most_t(spark):
    """Among ties the order of merging may differ from a plain loop, but every merge must be a closest pair."""
    X = grid(20)
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    merges = complete_linkage(centroid_frame(spark, X)).cache()
    clusters, Z = {i: [i] for i in range(n)}, []
    for r in merges.orderBy("step").collect():
        a, b = clusters.pop(r.left), clusters.pop(r.right)
        assert np.isclose(r.height, D[np.ix_(a, b)].max()) and r.size == len(a) + len(b)
        others = [D[np.ix_(x, y)].max() for i, x in clusters.items() for j, y in clusters.items() if i < j]
        others += [D[np.ix_(x, y)].max() for x in (a, b) for y in clusters.values()]
        assert r.height <= min(others, default=np.inf) + 1e-9
        clusters[n + len(Z)] = a + b
        Z.append((r.left, r.right, r.height, r.size))
    got = {}
    for r in cut_trees(merges, n, [1, 2, 4, 7, 19]).collect():
        got.setdefault(r.t, {}).setdefault(r.cluster, []).append(r.node)
    for t, groups in got.items():
        assert sorted(map(sorted, groups.values())) == flat(Z, n, t) and len(groups) <= t
        assert 0 in groups[1]


def test_two_trees_in_one_run_equal_two_runs(spark):
    rng = np.random.default_rng(2)
    X = {"raw": rng.normal(size=(15, 4)), "pca": rng.normal(size=(15, 2))}
    points = centroid_frame(spark, X["raw"], kind_of="raw").unionByName(centroid_frame(spark, X["pca"], kind_of="pca"))
    merges = complete_linkage(points, keys=["kind_of"]).cache()
    cuts = cut_trees(merges, 15, [4, 20], ["kind_of"]).cache()
    order = leaf_order(merges, 15, ["kind_of"]).cache()
    for kind, x in X.items():
        one = complete_linkage(centroid_frame(spark, x))
        pick = lambda df: sorted(tuple(r) for r in df.filter(f"kind_of = '{kind}'").drop("kind_of").collect())
        assert pick(merges) == sorted(tuple(r) for r in one.collect())
        assert pick(order) == sorted(tuple(r) for r in leaf_order(one, 15).collect())
        assert sorted(r[1:] for r in pick(cuts) if r[0] == 4) == sorted(tuple(r) for r in cut_tree(one, 15, 4).collect())


def test_single_point_has_no_merges(spark):
    merges = complete_linkage(centroid_frame(spark, [[1.0]]))
    assert merges.count() == 0
    assert [tuple(r) for r in leaf_order(merges, 1).collect()] == [(0, 0)]
