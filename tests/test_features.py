import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from setscope.operators.features import (
    choose_components, dictionary_vectors, explained_variance, feature_vectors, one_hot, pca_select, top_loadings,
    weighted_pca)
from setscope.sources import bindings as B
from setscope.sources.memberships import code_dictionary, code_domain, itemsets


def test_choose_components_band_no_band_and_one_code():
    cum = [0.3, 0.55, 0.7, 0.82, 0.9, 0.95, 1.0]
    assert choose_components(cum, 0.8, 0.85) == 4
    # no k in the band: the last k tried wins (tries k=2: 0.9 too high, then k=1: 0.5 too low)
    assert choose_components([0.5, 0.9, 1.0], 0.8, 0.85) == 1
    assert choose_components([1.0], 0.8, 0.85) == 1


def test_one_hot_and_vectors(spark):
    items = spark.createDataFrame([("a", [1, 3]), ("b", [2])], "id string, archives array<int>")
    rows = {r.id: (r["1"], r["2"], r["3"]) for r in one_hot(items, [1, 2, 3]).collect()}
    assert rows == {"a": (1, 0, 1), "b": (0, 1, 0)}
    vec = {r.id: r.features.toArray().tolist() for r in feature_vectors(items, [1, 2, 3]).collect()}
    assert vec == {"a": [1.0, 0.0, 1.0], "b": [0.0, 1.0, 0.0]}


def test_dictionary_vectors_equal_those_of_the_collected_codes(spark):
    rows = [("a", 30), ("a", 10), ("a", 10), ("b", 20), ("c", None), ("c", 7)]
    m = spark.createDataFrame(rows, "id string, archive int")
    words = code_dictionary(m)
    assert {r.archive: r.place for r in words.collect()} == {7: 0, 10: 1, 20: 2, 30: 3}
    got = {r.id: r.features.toArray().tolist() for r in dictionary_vectors(m, words).collect()}
    assert got == {"a": [0, 1, 0, 1], "b": [0, 0, 1, 0], "c": [1, 0, 0, 0]}
    known = words.where("archive <> 20")
    assert {r.id: list(r.features.indices) for r in dictionary_vectors(m.where("id = 'b'"), known).collect()} == {"b": []}
    none = m.where("false")
    assert code_dictionary(none).collect() == [] and dictionary_vectors(none, code_dictionary(none)).collect() == []


def test_dictionary_of_a_hundred_thousand_codes(spark):
    n = 100_000
    # every subject holds one hot code and two others; places are known in advance, since codes sort as padded text
    m = spark.range(n).selectExpr("cast(id % 50000 as string) as id", f"lpad(cast(id * 7919 % {n} as string), 6, '0') as archive")
    m = m.unionByName(m.select("id", F.lit("000000").alias("archive")))
    words = code_dictionary(m)
    wrong = words.where(F.col("archive").cast("int") != F.col("place"))
    assert words.count() == n and wrong.count() == 0
    vectors = dictionary_vectors(m, words)
    one = vectors.where("id = '12'").first().features
    assert one.size == n and list(one.indices) == sorted({0, 12 * 7919 % n, (50012 * 7919) % n})
    assert vectors.count() == 50_000


def test_pca_matches_numpy_and_loadings(spark):
    m, reg = B.order_nation(spark, SF_SMALL)
    codes = code_domain(m)
    feats = feature_vectors(itemsets(m), codes)
    model = pca_select(feats, 0.8, 0.85)
    X = np.array([r.features.toArray() for r in feats.collect()])
    w = np.linalg.eigvalsh(np.cov(X, rowvar=False))[::-1]
    ev = model.explained
    assert np.allclose(ev, (w / w.sum())[:len(ev)], atol=1e-9)
    k = len(ev)
    assert choose_components(list(np.cumsum(w / w.sum())), 0.8, 0.85) == k
    # the sliced projection equals a k-component fit
    from pyspark.ml.feature import PCA
    ref = PCA(k=k, inputCol="features", outputCol="pca_features").fit(feats).transform(feats)
    mine = model.transform(feats)
    signs = model.signs[:k]
    a = sorted(tuple(round(x, 9) + 0.0 for x in r.pca_features.toArray()) for r in mine.collect())
    b = sorted(tuple(round(x, 9) + 0.0 for x in r.pca_features.toArray() * signs) for r in ref.collect())
    assert a == b
    ex = explained_variance(spark, model).orderBy("pc").collect()
    assert [r.pc for r in ex] == list(range(k))
    top = top_loadings(spark, model, codes, reg, 3).collect()
    pc = model.pc
    assert all(pc[np.abs(pc[:, j]).argmax(), j] > 0 for j in range(k))
    for j in range(k):
        order = sorted(range(len(codes)), key=lambda i: (-abs(pc[i, j]), codes[i]))[:3]
        mine = [r.archive for r in sorted((r for r in top if r.pc == j), key=lambda r: (-abs(r.loading), r.archive))]
        assert set(mine) == {codes[i] for i in order}


def test_single_code_domain_gives_one_component(spark):
    from setscope.plans.analysis import build_analysis
    m = spark.createDataFrame([("a", 7), ("b", 7), ("b", 7), ("c", 7)], "id string, archive int")
    an = build_analysis(m)
    assert an.codes == [7] and an.pca.k == 1
    rows = {tuple(r.archives): r.weight for r in an.base.collect()}
    assert rows == {(7,): 3}
    an.release()


def test_vector_plan_does_not_grow_with_the_codes(spark):
    items = spark.createDataFrame([("a", [1, 3])], "id string, archives array<int>")
    sizes = [len(feature_vectors(items, list(range(n)))._jdf.queryExecution().optimizedPlan().toString()) for n in (3, 300)]
    assert sizes[1] < sizes[0] + 50


def test_weighted_pca_equals_the_fit_over_the_subjects(spark):
    rnd = np.random.default_rng(6)
    sets = [[int(c) for c in np.flatnonzero(rnd.random(7) < 0.15 * np.arange(1, 8) / 2)] for _ in range(300)]
    items = spark.createDataFrame([(s,) for s in sets], "archives array<int>")
    sets = items.groupBy("archives").agg(F.count("*").alias("weight"))
    codes = list(range(7))
    want, got = pca_select(feature_vectors(items, codes), 0.8, 0.85, size=7), weighted_pca(sets, codes, 0.8, 0.85)
    assert got.k == want.k
    assert np.allclose(got.explained, want.explained, atol=1e-12) and np.allclose(got.pc, want.pc, atol=1e-9)


def test_analysis_reads_the_memberships_once(spark):
    from setscope.plans.analysis import build_analysis

    m, _ = B.order_nation(spark, SF_SMALL)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    an = build_analysis(m.mapInArrow(counted, m.schema))
    assert an.codes == code_domain(m)
    assert reads.value == m.count()
    an.release()
