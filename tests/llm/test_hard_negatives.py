import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setscope.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, rank int, anchor_key string"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    good = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    clip = lambda s: min(max(s, -2**63), 2**63 - 1)
    out = []
    for q, lab, a in good:
        if q % 3:
            continue
        near = sorted((-dot(a, b), i) for i, other, b in good if other == lab and i != q)[:positives]
        for s, i in near:
            far = sorted((-dot(a, b), j) for j, other, b in good if other != lab)
            fits = [(t, j) for t, j in far if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(q, i, r, j, clip(-s), clip(-t)) for r, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = H.hard_negatives(df, F.col("vec_id") % 3 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, **options)


@pytest.mark.parametrize("blocks", [(8192, 2048), (25, 6)])
def test_against_brute_force_with_copies_and_ties(spark, monkeypatch, blocks):
    monkeypatch.setattr(H, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(H, "BLOCK_ANCHORS", blocks[1])
    rnd = random.Random(5)
    centre = [[rnd.gauss(0, 1) for _ in range(9)] for _ in range(4)]
    rows = [(i, lab, [c + rnd.gauss(0, 0.7) for c in centre[lab]]) for i in range(100) for lab in [rnd.randrange(4)]]
    rows += [(200 + i, i % 2, [0.5] * 9) for i in range(40)] + [(300 + i, 1, [0.0] * 9) for i in range(6)]
    check(spark, rows)
    check(spark, rows, positives=2, negatives=3, low=50, high=100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [1.0, 2.0]), (3, 1, [1.0]), (6, 1, []), (9, 1, None), (12, 1, [nan]),
            (15, 1, [inf, 0.0]), (18, 2, [None, 1.0]), (None, 1, [9.0]), (21, None, [1.0, 1.0]), (4, 1, [2.0, -1.0]),
            (5, 2, [0.5, 0.5]), (7, 2, [0.4, 0.6]), (8, 3, [-1.0, -1.0]), (8, 3, [0.7, 0.3]), (10, 1, [0.7, 0.7])]
    check(spark, rows)
    check(spark, rows[:3])
    check(spark, [])


def test_scores_beyond_a_double_and_a_long(spark):
    for big in (2.0**22, 2.0**40, 2.0**300):
        rows = [(i, i % 2, [big + i * big / 2**30, big - i * 3 * big / 2**29, 1.0]) for i in range(14)]
        rows += [(20 + i, i % 2, [big * 0.3, -big * i / 40, 2.0]) for i in range(14)]
        check(spark, rows)


def test_intervals_hold_every_score_and_shrink_with_the_levels():
    rnd = np.random.default_rng(3)
    x, q = np.floor(rnd.standard_normal((300, 70)) * 256), np.floor(rnd.standard_normal((40, 70)) * 256)
    x[:20] = 0
    norms, exact, widths = np.linalg.norm(x, axis=1), q @ x.T, []
    for levels in (1, 3, 7):
        turns = H.rotations(70, levels)
        low, high = H.intervals(q, *H.one_bit_codes(x, turns), norms, turns)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[0] > 2 * widths[1] > 4 * widths[2]
