import random

import numpy as np
import pyarrow as pa
import pytest

from setscope.llm import minhash as M
from setscope.llm.components import connected_components

SCHEMA = "doc_id long, text string, node string, key int, component_id int"


def shingles(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows, least=85):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    root = lambda i: i if group[i] == i else root(group[i])
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= least * (len(sets[i]) + len(sets[j]) - common):
                group[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), set()).add(d)
    low = {g: min((d for d in own if d is not None), default=None) for g, own in ids.items()}
    return sorted(((d, len(s), low[root(i)], d == low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    got = M.near_duplicates(df, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, **options)


def changed(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("part", [512, 3])
def test_copies_near_copies_and_a_shared_passage(spark, monkeypatch, part):
    monkeypatch.setattr(M, "PART", part)
    rnd = random.Random(part)
    word = lambda: f"w{rnd.randrange(5000)}"
    base = [word() for _ in range(220)]
    passage = [word() for _ in range(90)]
    texts = [changed(rnd, base, rnd.randrange(6)) for _ in range(40)]               # near copies, some only by way of others
    texts += [" ".join(base)] * 15 + [" ".join(base).upper()] * 3                      # copies
    texts += [" ".join(passage + [word() for _ in range(rnd.randrange(10, 60))]) for _ in range(50)]  # a passage in common
    chain = base[:]
    for _ in range(12):
        chain = changed(rnd, chain, 2).split(" ")
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(rnd.randrange(1, 300))) for _ in range(60)]
    rnd.shuffle(texts)
    check(spark, [(i * 3 + 5, t) for i, t in enumerate(texts)])


def family(rnd, n, edits):
    """Texts that each change other words of one text: many share tables, whether they are linked or not."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    return [changed(rnd, base, edits) for _ in range(n)]


def test_a_family_below_the_limit_makes_few_rows(spark, monkeypatch):
    rnd = random.Random(8)
    rows, verified = list(enumerate(family(rnd, 150, 3) + family(rnd, 40, 1))), []

    def spy(pairs, *more, plain=M._verified):
        verified.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(M, "_verified", spy)
    check(spark, rows)
    # at most one a row of the tables of equal numbers; all pairs of the first family are 11,175
    assert sum(verified) <= 22 * len(rows)


@pytest.mark.parametrize("limit", [("BLOCK", 7), ("BLOCK_BYTES", 20_000)])
def test_blocks_of_a_large_bucket(spark, monkeypatch, limit):
    monkeypatch.setattr(M, *limit)
    rnd = random.Random(9)
    # no turns: all pairs, also those of one component, are left to the blocks
    monkeypatch.setattr(M, "_met", lambda buckets, *_: buckets.sparkSession.createDataFrame([], "node long, component long"))
    check(spark, list(enumerate(family(rnd, 40, 3) + family(rnd, 40, 1) + family(rnd, 30, 2))))


def test_block_links_verify_a_pair_once():
    offsets, values = M.shingle_sets(pa.array(["a b c d e f g h", "a b c d e f g h i", "p q r s t u", "a b c d e f g h"]))
    sets = [values[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
    ones = np.array([[5] * M.BANDS, [5] * M.BANDS, [5] + [6] * (M.BANDS - 1), [5] * M.BANDS])

    def links(band, side=(0, 0, 0, 0), c=(1, 2, 3, 4), twos=ones):
        lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in (ones, twos)]
        n = pa.array([len(x) for x in sets])
        return M.block_links(pa.table({"band": [band] * 4, "side": list(side), "node": [1, 2, 3, 4], "c": list(c), "n": n, "most": n,
                                       "one": lists[0], "two": lists[1], "shingles": [x.tobytes() for x in sets]}), 80)

    assert links(0) == [(1, 2), (1, 4)]
    assert links(1) == []                                   # left to band 0
    assert links(0, c=(1, 1, 3, 4)) == [(1, 4)]             # what is one component does not meet
    assert links(0, side=(0, 0, 1, 1)) == [(1, 4), (2, 4)]  # side 0 meets side 1 alone
    assert links(0, twos=np.arange(4 * M.BANDS).reshape(4, -1)) == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, "alone here now"),
            (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d e a b c d e a b c d e"), (9, "é É"), (10, "É É"), (None, None)]
    check(spark, rows)
    check(spark, [])
    check(spark, rows[:3])


def test_long_texts_at_the_limit(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(20000)]
    # 17,000 of 20,000 shingles in common: exactly 85 hundredths of the union; one fewer is not linked
    rows = [(1, " ".join(words[:17004])), (2, " ".join(words[:20004])), (3, " ".join(words[:17003]))]
    rows[1] = (2, " ".join(words[:20000] + ["x1", "x2", "x3", "x4"]))
    check(spark, rows)
    check(spark, rows, least=100)


def test_a_pair_at_the_limit_shares_a_table():
    rnd = np.random.default_rng(4)
    met = 0
    for i in range(400):
        common = rnd.integers(0, 2**63, 170, dtype=np.uint64)
        sets = [np.sort(np.concatenate((common, rnd.integers(0, 2**63, 15, dtype=np.uint64)))) for _ in range(2)]
        a, b = M.band_values(np.array([0, 185, 370]), np.concatenate(sets))
        met += (a == b)[:M.BANDS].any() and (a == b)[M.BANDS:].any()
    assert met >= 399


def test_sets_do_not_depend_on_the_batch():
    texts = pa.array(["a b c d e f g", "A B C D E f g h", None, "", "x", "a b c d e a b c d e"])
    offsets, values = M.shingle_sets(texts)
    assert list(np.diff(offsets)) == [3, 4, 0, 0, 1, 5]
    for i, t in enumerate(texts):
        own = M.shingle_sets(pa.array([t], pa.string()))[1]
        assert list(own) == list(values[offsets[i]:offsets[i + 1]])


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(got.values()) == {0} and len(got) == 305
