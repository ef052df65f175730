import math
import random
import zlib

import numpy as np
import pytest

from setscope.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"
WORDS = {"en": "the of and house water thing reading", "de": "der die und haus wasser sache lesen",
         "fr": "le la et maison eau chose lire"}


def rows(n, rnd, lo=2, hi=30):
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choices(WORDS[lang].split(), k=rnd.randint(lo, hi))), lang, "x", 7))
    return out


def total_probability(word, table, ids, longest):
    """Sum over all ways to cut a word into pieces, one by one."""
    if not word:
        return np.ones(table.shape[1])
    total = np.zeros(table.shape[1])
    for k in range(1, min(longest, len(word)) + 1):
        piece = word[:k]
        p = table[ids[piece]] if piece in ids else L.UNKNOWN if k == 1 else 0
        if np.any(p):
            total = total + p * total_probability(word[k:], table, ids, longest)
    return total


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(spark.createDataFrame(rows(300, random.Random(1)), SCHEMA))


def test_forward_sums_all_segmentations(model):
    scorer = L.Scorer(model)
    texts = ["▁the", "▁wasser", "▁", "x", "▁日本", "▁reading", "ǅ", "▁lesen"]
    got = scorer.log_probs(texts)
    for text, row in zip(texts, got):
        want = np.log(total_probability(text, model["table"], scorer.ids, scorer.longest))
        assert np.allclose(row, want, rtol=1e-9)
    assert np.isfinite(scorer.log_probs(["▁" + "q" * 5000])).all()


def test_held_out_accuracy_and_columns(spark, model):
    docs = rows(300, random.Random(1))
    out = L.identify(spark.createDataFrame(docs, SCHEMA), model).collect()
    truth = {d[0]: d[2] for d in docs}
    assert len(out) == 300
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == truth[r.doc.doc_id] and 0 <= r.score <= 1
        assert (r.doc.score, r.doc.held_out) == ("x", 7)


def test_learns_nothing_from_held_out_rows(spark):
    docs = rows(200, random.Random(4))
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, a, b) for i, t, lang, a, b in docs]
    a, b = (L.learn(spark.createDataFrame(d, SCHEMA)) for d in (docs, lied))
    assert a["langs"] == b["langs"] and np.array_equal(a["table"], b["table"]) and np.array_equal(a["prior"], b["prior"])


def test_odd_texts_nulls_and_empty_tables(spark, model):
    odd = [(1, None, "en", "", 0), (2, "", "en", "", 0), (3, "12 !! ² _", None, "", 0), (None, "der die und", None, "", 0),
           (4, "und " * 40_000, "de", "", 0), (4, "THE OF AND", "de", "", 0), (5, "ªª", "en", "", 0)]
    got = {(r.doc.doc_id, r.text): (r.lang_pred, r.score) for r in
           L.identify(spark.createDataFrame(odd, SCHEMA), model, keep_text=True).collect()}
    assert got[1, None] == got[2, ""] == got[3, "12 !! ² _"] == ("und", 0.0)
    assert got[None, "der die und"][0] == "de" and got[4, "und " * 40_000][0] == "de" and got[4, "THE OF AND"][0] == "en"
    assert got[5, "ªª"][0] != "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, "", 0)], SCHEMA)
    assert L.identify(unlabelled).collect()[0].lang_pred == "und"


def test_sample_is_bounded_and_shares_count_all(spark):
    docs = spark.createDataFrame([(i, "der", "de", "", 0) for i in range(3000)], SCHEMA)
    model = L.learn(docs, sample_docs=100)
    seen = 1 / model["table"].min() * L.SMOOTHING - L.SMOOTHING * len(model["table"])
    assert math.isclose(seen, 100, rel_tol=0.5) and model["prior"].tolist() == [0.0]
