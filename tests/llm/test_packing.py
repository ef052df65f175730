import os
import random
import zlib

import numpy as np
import pytest

from setscope.llm import packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def check(spark, rows, capacity=64):
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    got = packing.pack(df, capacity=capacity).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = np.array(ids_of(text), dtype="<u4")
        want += [(doc_id, k, a, len(p), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), capacity))
                 for p in [ids[a:a + capacity]]]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    placed = {}
    for r in got:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in placed.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return placed


def test_whole_texts_round_trip_and_places(spark):
    rnd = random.Random(2)
    odd = ["It's we'LL", "ÀÉ ß Σας ΑΣ", "é ́x", "a b　c d", "<|endoftext|> x<|endoftext|>y",
           "12 345 !!! #$%", "x" * 500, "日本語 テスト", "\x1c\x85a", "😀😀"]
    rows = [(i, " ".join(rnd.choices(odd, k=rnd.randint(1, 12))), 0) for i in range(60)]
    rows += [(100, None, 0), (101, "", 0), (102, " \n\t", 0), (None, "no id", 0), (7, "same id", 0), (7, "same id", 0)]
    rows.append((200, "word " * 5000, 1))
    check(spark, rows)


def test_empty_table(spark):
    assert check(spark, []) == {}


def test_sequences_hold_the_ids(spark):
    rows = [(i, f"text number {i} " * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.sequences(df, capacity=64).collect()
    assert sorted(t for r in out for t in r.ids) == sorted(t for _, x in rows for t in ids_of(x))
    assert all(len(r.ids) <= 64 for r in out)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 30, 100])
    counts = {k: rnd.choice([0, 1, 2, 3, 50]) for k in rnd.sample(range(1, capacity + 1), rnd.randint(1, capacity))}
    plan = packing.packing_plan(counts, capacity)
    fill, large = {}, {}
    for i, (length, rank, seq, each, offset) in enumerate(plan):
        last = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
        for r in range(rank, last):
            s = seq + (r - rank) // each
            fill.setdefault(s, []).append((offset + (r - rank) % each * length, length))
            large[s] = large.get(s, 0) + (3 * length > capacity)
    assert sum(map(len, fill.values())) == sum(counts.values())
    for p in fill.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    assert max(large.values(), default=0) <= 2


def test_plan_is_tight_and_bounded():
    rnd = random.Random(1)
    counts = {k: rnd.randint(1, 10_000) for k in range(1, 4097)}
    plan = packing.packing_plan(counts)
    used = int(plan[:, 2].max()) + 1
    assert len(plan) < 40_000
    need = sum(k * n for k, n in counts.items()) / 4096
    assert used < 1.02 * max(need, sum(n for k, n in counts.items() if 2 * k > 4096))
