import random
import re
import zlib

import numpy as np
import pyarrow as pa

from setscope.llm import logistic, quality
from setscope.llm.grams import char_grams
from setscope.llm.text import split_words

SCHEMA = "doc_id long, text string, quality string, kept int"
LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    cover = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(cover),
            n < 50 or 100 * len(cover) > 50 * n)


def corpus(rnd, n):
    good = ["house", "water", "reads", "slowly", "green", "of", "the", "and", "evening", "light", "stone", "river"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [rnd.choice(good) + rnd.choice(["", "s", "ed", "ing"]) + str(rnd.randrange(30)) for _ in range(rnd.randint(60, 120))]
        docs.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "q", 1))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_base_counts_against_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t ", "a b c a b c", "x x x x x", "l 1\nl 1\n\n\nl 1 \n é#\x85", "w " * 30_000]
    texts += [" ".join(rnd.choices(["a", "b", "#c", "d|", "é", "\n", "\n"], k=rnd.randint(1, 90))) for _ in range(60)]
    texts += ["one two three four " * 12 + " ".join(map(str, range(60))), " ".join(map(str, range(50)))]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], SCHEMA)
    for r in quality.judge(df, None).collect():
        want = counts(texts[r.doc_id]) if r.doc_id != 6 else (30_000, 30_000, 0, 0, 30_000, True)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.quality is None and r.kept == (not r.base_failed)


def test_learned_verdicts_on_unseen_rows(spark):
    docs, labels = corpus(random.Random(4), 400)
    model = quality.learn(spark.createDataFrame(docs[:200], SCHEMA), spark.createDataFrame(labels, LABELS))
    got = quality.judge(spark.createDataFrame(docs, SCHEMA), model).collect()
    right = [r.kept == bool(labels[r.doc_id][1]) for r in got if r.doc_id >= 200]
    assert len(got) == 400 and sum(right) / len(right) > 0.97
    assert all(0 <= r.quality <= 1 for r in got)


def test_scores_summed_by_word_equal_the_feature_row(spark):
    rnd = np.random.default_rng(1)
    model = {"w": rnd.normal(size=3 * quality.BUCKETS), "b": 0.3, "a": 0.7, "c": -0.2}
    texts = ["One two two, three!", "x", "", "ÀÉ 😀 a b c a b c"]
    offsets, words = split_words(pa.array(texts))
    got = quality.probabilities(offsets, words, model, quality._word_table(model))
    for text, p in zip(texts, got):
        index, value = quality.features(text.split())
        z = value @ model["w"][index] / quality.SCALE + model["b"]
        assert np.isclose(p, logistic.sigmoid(model["a"] * z + model["c"]))


def test_char_grams_by_hand():
    of, bucket = char_grams(["ab", "", "c"], (1, 2, 3), 1 << 40)
    assert of.tolist() == [0] * 7 + [2] * 4  # a b ^a ab b$ ^ab ab$; c ^c c$ ^c$
    assert len(set(bucket.tolist())) == 11


def test_no_labels_and_odd_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "", 0), (None, "x", "", 0)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert quality.learn(docs, none) is None
    assert quality.learn(docs, spark.createDataFrame([(1, 1, 0), (None, 0, 0), (1, None, 1)], LABELS)) is None
    assert quality.judge(spark.createDataFrame([], SCHEMA), None).count() == 0
    assert quality.judge(docs, None).filter("kept").count() == 0


def test_sample_is_bounded(spark):
    docs, labels = corpus(random.Random(8), 90)
    from setscope.llm.folds import labelled_texts
    rows, total = labelled_texts(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels * 2, LABELS),
                                 "quality", 7, True, "s")
    got = rows.collect()
    assert len(got) == 14 and sum(total.values()) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(90))
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)


def test_calibration_recovers_a_known_curve():
    rnd = np.random.default_rng(0)
    z = rnd.normal(size=20_000) * 3
    y = (rnd.random(20_000) < logistic.sigmoid(0.5 * z - 1)).astype(float)
    a, b = logistic.calibrate(z, y, np.ones(len(z)))
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.1
