import random
import zlib

import numpy as np
import pytest

from setscope.llm import gru, logistic, toxicity

SCHEMA = "doc_id long, text string, score string, predicted int"
LABELS = "doc_id long, quality int, toxic int"
STEMS = ["grolb", "smurk", "vazzi"]


def corpus(rnd, n):
    """Texts of made-up words; toxic ones hold a few words of a few stems with any ending."""
    syllables = ["ta", "le", "mor", "in", "ed", "ou", "ste", "na", "fi"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(20, 200))]
        toxic = rnd.random() < 0.25
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(STEMS) + rnd.choice(syllables) + rnd.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(random.Random(3), 450)
    d, l = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    return docs, labels, toxicity.learn(d, l)


def test_held_out_accuracy(spark, fitted):
    docs, labels, model = fitted
    got = toxicity.score(spark.createDataFrame(docs, SCHEMA), model).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [r.predicted == labels[r.doc_id][2] for r in held]
    assert sum(right) / len(right) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_windows_are_all_seen(spark, fitted):
    """One toxic word anywhere in a long clean text is found; the text alone counts."""
    _, _, model = fitted
    clean = ["tale", "morin", "edou", "stena"] * 150
    rows = []
    for i, at in enumerate(range(0, len(clean) + 1, 37)):
        rows.append((i, " ".join(clean[:at] + ["smurkta", "grolble"] + clean[at:]), "", 0))
    rows.append((1000, " ".join(clean), "", 0))
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got.pop(1000) == 0 and all(got.values())


def test_odd_rows_and_missing_labels(spark, fitted):
    _, _, model = fitted
    rows = [(1, None, "", 0), (2, "", "", 0), (None, "smurkta grolble vazzila", "", 0), (3, "!! ??", "", 0),
            (4, "smurkta grolble " * 20_000, "", 0), (4, "tale", "", 0)]
    got = {}
    for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect():
        got.setdefault(r.doc_id, []).append(r.predicted if r.score else 0.0)
    assert got[1] == got[2] == [0.0]
    assert got[None] == [1] and got[3] == [0] and sorted(got[4]) == [0, 1]
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0
    df = spark.createDataFrame(rows, SCHEMA)
    assert toxicity.learn(df, spark.createDataFrame([(2, 1, 1)], LABELS)) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}


def test_learns_nothing_from_held_out_rows(spark, fitted):
    docs, labels, model = fitted
    lied = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    again = toxicity.learn(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(lied, LABELS))
    for k in ("w", "uf", "o", "words", "grams", "counts"):
        assert np.allclose(model[k], again[k], rtol=1e-6)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 48, 49, 64, 65, 100])
def test_windows_cover_every_word(n):
    starts = toxicity.window_starts(n)
    assert starts[0] == 0 and set(np.diff(starts)) <= {toxicity.STRIDE}
    assert starts[-1] < n <= starts[-1] + toxicity.SIZE
    assert len(starts) == 1 or starts[-2] + toxicity.SIZE < n


def test_gradients_against_differences():
    rnd = np.random.default_rng(5)
    params = gru.initial(5, seed=2)
    x, mask = rnd.normal(size=(4, 3, 5)), np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 0]], dtype=bool)
    y = np.array([1.0, 0.0, 1.0])

    def loss(p):
        z = gru.forward(p, x @ p["w"] + p["c"], mask)
        q = logistic.sigmoid(z)
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()

    z, kept = gru.forward(params, x @ params["w"] + params["c"], mask, keep=True)
    grads, d_projected = gru.backward(params, kept, mask, logistic.sigmoid(z) - y)
    grads["w"] = np.einsum("twi,twp->ip", x, d_projected)
    grads["c"] = d_projected.sum(axis=(0, 1))
    for name, g in grads.items():
        for _ in range(6):
            at = tuple(rnd.integers(0, s) for s in params[name].shape)
            bumped = {k: v.copy() for k, v in params.items()}
            bumped[name][at] += 1e-5
            lower = {k: v.copy() for k, v in params.items()}
            lower[name][at] -= 1e-5
            assert np.isclose((loss(bumped) - loss(lower)) / 2e-5, g[at], rtol=1e-4, atol=1e-7), name
