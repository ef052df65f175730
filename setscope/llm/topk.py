"""Exact top-k inner products by the three-phase uniform threshold.

A score is the sum of partial scores over ``PARTS`` ranges of components, each
of which a block of rows can list by itself. Phase 1 gathers the longest local
lists and takes the k-th best score of what they name as a safe cutoff. An
entry that reaches the cutoff has a partial score of at least cutoff / PARTS
in some list: phase 2 hands the cutoffs out and collects these entries, phase
3 adds up their remaining parts and keeps what reaches the cutoff.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.session import materialize

K = 5
PARTS = 2
SCALE = 256
#: Expected rows and queries of one block; a task holds one pair of blocks.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(256 x) of all vectors; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = np.floor(SCALE * np.asarray(v, dtype=np.float64))
    return out


def _partial_scores(rows: pd.DataFrame, queries: pd.DataFrame) -> list[np.ndarray]:
    """Inner products (queries x rows) of each range of components, exact; a query's own id counts as no entry."""
    width = max(max(map(len, rows["vector"])), max(map(len, queries["vector"])), PARTS)
    x, q = _matrix(rows["vector"], width), _matrix(queries["vector"], width)
    if np.abs(x).max() * np.abs(q).max() * width * PARTS >= EXACT:
        x, q = (np.vectorize(int, otypes=[object])(m) for m in (x, q))
    cuts = [round(p * width / PARTS) for p in range(PARTS + 1)]
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _best(query: pd.Series, ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray,
          k: int) -> pd.DataFrame:
    """The k best entries of each query, ties to the smaller id; scores outside a long stop at its ends."""
    scores = np.array([min(max(int(s), -2**63), 2**63 - 1) for s in scores], dtype=np.int64) \
        if scores.dtype == object else scores.astype(np.int64)
    order = np.lexsort((ids[cols], -scores.astype(np.float64), rows))
    if len(scores) and np.abs(scores.astype(np.float64)).max() >= EXACT:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -int(scores[i]), ids[cols[i]])))
    rows, cols, scores = rows[order], cols[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return pd.DataFrame({"query": query.to_numpy()[rows[keep]], "vec_id": ids[cols[keep]], "score": scores[keep]})


def _phase_one(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids = rows["vec_id"].to_numpy()
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
        parts = _partial_scores(rows, queries)
        own = ids[None, :] == queries["vec_id"].to_numpy()[:, None]
        named = np.zeros(own.shape, dtype=bool)
        for p in parts:
            shown = np.where(own, -np.inf, p.astype(np.float64))
            top = np.argpartition(-shown, min(k, len(ids)) - 1, axis=1)[:, :k]
            np.put_along_axis(named, top, True, axis=1)
        q, x = np.nonzero(named & ~own)
        return _best(queries["query"], ids, q, x, sum(p[q, x] for p in parts), k)

    return run


def _phase_two_and_three(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids = rows["vec_id"].to_numpy()
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
        parts = _partial_scores(rows, queries)
        cutoff = queries["cutoff"].to_numpy()
        open_ = queries["open"].to_numpy()
        enough = open_[:, None] | np.logical_or.reduce([p * PARTS >= cutoff[:, None] for p in parts])
        q, x = np.nonzero(enough & (ids[None, :] != queries["vec_id"].to_numpy()[:, None]))
        scores = sum(p[q, x] for p in parts)
        reach = (scores >= cutoff[q]) | open_[q]
        return _best(queries["query"], ids, q[reach], x[reach], scores[reach], k)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row of (vec_id, embedding) that is a query.

    Ties go to the smaller vec_id, and a query's own vec_id is no candidate.
    Vectors that are null or hold null or non-finite components, and rows
    without vec_id, take no part; a shorter vector counts as ending in
    zeros. Repeated rows are rows of their own as candidates; a query that
    repeats with an equal vector is one query, with another vector another
    one under the same id. An empty table gives an empty result. All queries
    meet all rows in blocks of bounded size, and a block returns k entries a
    query at most, so neither side is broadcast nor gathered.
    """
    usable_rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("asks"))
    queries = (usable_rows.where("asks").select("vec_id", "vector").distinct()
               .withColumn("query", F.xxhash64("vec_id", "vector")))
    found = usable_rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    row_blocks, query_blocks = (max(1, math.ceil(n / size)) for n, size in zip(found, (BLOCK_ROWS, BLOCK_QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = usable_rows.select(
        "vec_id", "vector", every(query_blocks).alias("qb"),
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int").alias("rb")).groupBy("rb", "qb")
    out = "query long, vec_id long, score long"

    def asked(q: DataFrame):
        return q.withColumn("qb", F.pmod(F.col("query"), F.lit(query_blocks)).cast("int")).withColumn(
            "rb", every(row_blocks)).groupBy("rb", "qb")

    gathered = placed.cogroup(asked(queries)).applyInPandas(_phase_one(k), out)
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    cutoffs = (gathered.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k)
               .groupBy("query").agg(F.min("score").alias("cutoff"), (F.count("*") < k).alias("open")))
    with_cutoff = materialize(queries.join(cutoffs, "query", "left").select(
        "query", "vec_id", "vector", F.coalesce("cutoff", F.lit(0).cast("long")).alias("cutoff"),
        F.coalesce("open", F.lit(True)).alias("open")), "cutoffs")
    entries = placed.cogroup(asked(with_cutoff)).applyInPandas(_phase_two_and_three(k), out)
    ranked = entries.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    names = with_cutoff.select(F.col("query").alias("q"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, ranked["query"] == names["q"]).select("query_id", "rank", "vec_id", "score")
