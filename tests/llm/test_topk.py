import math
import random

import pytest
from pyspark.sql import functions as F

from setscope.llm import topk

SCHEMA = "vec_id long, embedding array<double>, query string, rank int"


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 3 == 0}:
        scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def check(spark, rows, k=5):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k)


@pytest.mark.parametrize("blocks", [(4096, 1024), (20, 5)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(topk, "BLOCK_QUERIES", blocks[1])
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(7)]) for i in range(90)]
    rows += [(i, [0.5] * 7) for i in range(200, 230)] + [(i, [0.0] * 7) for i in range(300, 306)]
    check(spark, rows)


def test_odd_vectors_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (3, [1.0]), (6, []), (9, None), (12, [nan, 1.0]), (15, [inf, 0.0]), (18, [None, 1.0]),
            (None, [9.0, 9.0]), (4, [2.0, -1.0]), (4, [2.0, -1.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0]), (21, [-1.0, 0.0]),
            (24, [-5.0, -5.0])]
    check(spark, rows)
    check(spark, rows, k=2)


def test_scores_beyond_double_precision(spark):
    big = 2.0**22
    check(spark, [(i, [big + i / 256, big - i * 3 / 256, 1.0]) for i in range(12)])


def test_fewer_rows_than_k_and_empty_table(spark):
    check(spark, [(0, [1.0]), (1, [1.0]), (3, [2.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])
