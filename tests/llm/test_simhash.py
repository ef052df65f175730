import random
import re

import numpy as np
import pytest
import xxhash

from setscope.llm import gray_index, simhash
from setscope.llm.components import connected_components


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = max(len(words) - 3, 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def check(spark, rows):
    """Operator against brute force on (doc_id, text) rows."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "row_key", "fp", "component_id", "group_fp"]
    got = got.select("doc_id", "fp", "component_id")
    fps = [fingerprint(t) for _, t in rows]
    root = components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    expect = sorted(((i, f, first.get(root[f])) for (i, _), f in zip(rows, fps)), key=repr)
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got.collect()), key=repr) == expect


def test_texts_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["alpha", "beta", "Gamma", "delta", "é", "x" * 30, "the", "of", " ", "b"]
    texts = [" ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 3, 4, 5, 60]))) for _ in range(60)]
    for t in texts[:20]:
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        texts += [" ".join(words), t.upper(), t]
    long = " ".join(rnd.choices(vocab, k=3000))
    texts += [None, "", " \t\n", long, long + " tail", "\x1fone\x0btwo"]
    check(spark, [(i * 7 % 101, t) for i, t in enumerate(texts)])


def test_nulls_ties_and_empty_tables(spark):
    check(spark, [(None, None), (None, "only here"), (3, "a b c d"), (3, "a b c d"), (2, "a b c d"), (None, "a b c d")])
    check(spark, [])


def test_null_ids_alone_have_no_component_name(spark):
    df = spark.createDataFrame([(None, "x y"), (None, "x y")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(df).collect()] == [None, None]


@pytest.mark.parametrize("part", [8192, 16])
def test_links_of_codes_at_every_distance(spark, monkeypatch, part):
    """Codes around a few centres, so that chains and dense groups occur; small parts split the patterns."""
    monkeypatch.setattr(simhash, "PART", part)
    rnd = random.Random(11)
    codes = {rnd.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    for centre in list(codes)[:8]:
        for _ in range(40):
            c = centre
            for b in rnd.sample(range(64), rnd.randint(1, 7)):
                c ^= 1 << b
            codes.add(c)
    codes = sorted(codes)
    signed = {simhash._signed(c): c for c in codes}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = connected_components(simhash.near_links(df)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(signed[r.node])
    root = components(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    expect = {}
    for c in codes:
        expect.setdefault(root[c], set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expect.values() if len(g) > 1)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(gray_index.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_dense_group_gives_spanning_links_only():
    codes = np.arange(4096, dtype=np.uint64)
    a, b = gray_index.link(codes, np.zeros(4096, dtype=np.int64), 4)
    assert len(a) == 4095 and len(set(b.tolist())) == 1


def test_masks_cover_every_distance():
    masks = simhash.pattern_masks(4)
    rnd = random.Random(1)
    for _ in range(300):
        differ = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(differ & m == 0 for m in masks)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)}


def test_keep_first_leaves_one_row_of_each_group(spark):
    schema = "doc_id long, text string, fp string, key int, row_key int"
    rows = [(3, "a b c d", "x", 1, 1), (2, "A b c d", "y", 1, 1), (2, "a b c d", "x", 1, 1), (2, "a b c d", "x", 1, 1),
            (None, "a b c d", "n", 1, 1), (None, "lonely", "n", 1, 1), (None, "lonely", "n", 1, 1), (5, None, "e", 1, 1),
            (6, "", "e", 1, 1), (9, "other words here", "z", 1, 1)]
    out = simhash.keep_first(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "fp", "key", "row_key"]
    got = sorted((r.doc_id or -1, (r.text or "").lower()) for r in out.collect())
    assert got == [(-1, "lonely"), (2, "a b c d"), (5, ""), (9, "other words here")]
