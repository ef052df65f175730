"""Cluster diameter: largest distance between two distinct points of a cluster.

Exact, without pairing every point with every other:

1. points are deduplicated per cluster (a cluster of one distinct point has
   diameter 0.0);
2. farthest-point passes give a lower bound L per cluster; each pass reads the
   points once and writes one pivot row per cluster;
3. L is the distance of a pair (u, v); two points inside the ball of radius
   L/2 around the midpoint of u and v are at most L apart, so a longer pair
   has an endpoint outside that ball. Only those outside points get partners,
   and only partners that upper bounds do not rule out; the answer is the
   larger of L and the best of these pairs.

For 0/1 itemsets d^2 = |A| + |B| - 2|A & B| <= |A| + |B|, so a partner must
have |A| + |B| > L^2: the pair join is an equi join on (cluster, partner
size), salted so that one size of one cluster is spread over tasks. Itemsets
are packed into longs, one bit per code, so a distance is a bit count. For
dense vectors the bound is the triangle inequality through the pivots; points
are dealt into blocks of at most some ``BLOCK_BYTES``, and a pair of blocks is
a key of its own, so a hot cluster of B blocks is spread over B (B + 1) / 2
keys and every unordered pair is met once, by matrix products of the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.session import materialize

EPS = 1e-9
#: Keys that the partners of one size are dealt over.
SALTS = 8
#: Bytes of the vectors of a block; a task holds two blocks.
BLOCK_BYTES = 4 << 20
#: Distances held at once when two blocks meet.
PAIRS_AT_ONCE = 1 << 20


def pack_items(col: str, codes: Sequence) -> Column:
    """An itemset as longs with one bit per code of ``codes``, 64 codes to a long."""
    place = F.transform(col, lambda c: F.array_position(F.lit(list(codes)), c) - 1)
    words = F.sequence(F.lit(0), F.lit(max(0, len(codes) - 1) // 64))
    bit = F.array(*[F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long") for i in range(64)])
    return F.transform(words, lambda w: F.aggregate(
        F.filter(place, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"),
        lambda a, p: a.bitwiseOR(F.get(bit, (p % 64).cast("int")))))


def _bits(words: Column, n: int) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(words[i]) for i in range(n)])


def _set_d2(a: Column, b: Column, n: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(n)])


def _vec_d2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _farthest(pts: DataFrame, keys: list[str], pivots: DataFrame, d2) -> DataFrame:
    """For each cluster the point farthest from its pivot ``_pv`` and the distance; written, one row per cluster."""
    j = pts.join(pivots.select(*keys, "_pv"), keys).withColumn("_d2", d2(F.col("_p"), F.col("_pv")))
    best = F.max(F.struct("_d2", "_p"))
    return materialize(j.groupBy(*keys).agg(best.alias("_m")).select(
        *keys, F.col("_m._p").alias("_pv"), F.col("_m._d2").alias("_r2")), "pivots")


def itemset_diameter(df: DataFrame, keys: Sequence[str], items_col: str = "archives",
                     codes: Sequence | None = None) -> DataFrame:
    """(keys..., value): diameter of the 0/1 vectors of each cluster's itemsets.

    ``codes`` is the code domain; without it the distinct codes are read first.
    """
    keys = list(keys)
    if codes is None:
        codes = [r[0] for r in df.select(F.explode(items_col).alias("c")).distinct().orderBy("c").collect()]
    n = max(1, -(-len(codes) // 64))
    # distinct points are read by every pass: computed once and written
    packed = df.select(*keys, pack_items(items_col, codes).alias("_p")).distinct()
    pts = materialize(packed.withColumn("_s", _bits(F.col("_p"), n)), "diameter-points")
    d2 = lambda a, b: _set_d2(a, b, n)
    p0 = materialize(pts.groupBy(*keys).agg(F.max(F.struct("_s", "_p")).alias("_m")).select(
        *keys, F.col("_m._p").alias("_pv"), F.col("_m._s").alias("_smax")), "pivots")
    p1 = _farthest(pts, keys, p0, d2)
    p2 = _farthest(pts, keys, p1, d2)
    # L^2 = d^2(u, v) with u the second pivot and v its farthest point (>= the first radius)
    bound = (p0.select(*keys, "_smax").join(p1.select(*keys, F.col("_pv").alias("_u")), keys)
             .join(p2.select(*keys, F.col("_pv").alias("_v"), F.col("_r2").alias("_lb")), keys))
    # only points that can reach beyond the bound with the largest partner
    cand = pts.join(bound, keys).filter(F.col("_s") + F.col("_smax") > F.col("_lb"))
    # outside the ball around the midpoint m of u, v: 4|x - m|^2 = 2 d^2(x, u) + 2 d^2(x, v) - d^2(u, v) > L^2
    x, u, v = F.col("_p"), F.col("_u"), F.col("_v")
    cand = materialize(cand.select(*keys, "_p", "_s", "_smax", "_lb", (
        2 * d2(x, u) + 2 * d2(x, v) - F.col("_lb") > F.col("_lb")).alias("_out")), "diameter-candidates")
    left = cand.filter("_out").select(*keys, F.col("_p").alias("_a"), F.explode(F.sequence(
        F.greatest(F.col("_lb") + 1 - F.col("_s"), F.lit(1)), F.col("_smax"))).alias("_sb")).select(
        "*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    right = cand.select(*keys, F.col("_p").alias("_b"), F.col("_s").alias("_sb"),
                        F.pmod(F.xxhash64("_p"), F.lit(SALTS)).cast("int").alias("_salt"))
    pairs = (left.join(right, [*keys, "_sb", "_salt"])
             .groupBy(*keys).agg(F.max(d2(F.col("_a"), F.col("_b"))).alias("_pair")))
    return (bound.select(*keys, "_lb").join(pairs, keys, "left")
            .select(*keys, F.sqrt(F.greatest(F.col("_lb"), F.coalesce("_pair", F.lit(0))).cast("double"))
                    .alias("value")))


def vector_diameter(df: DataFrame, keys: Sequence[str], col: str = "features",
                    passes: int = 3) -> DataFrame:
    """(keys..., value): diameter of dense vectors (vector or array column) per cluster."""
    keys = list(keys)
    arr = vector_to_array(col) if dict(df.dtypes)[col] == "vector" else F.col(col).cast("array<double>")
    pts = materialize(df.select(*keys, arr.alias("_p")).distinct(), "diameter-points")
    norm2 = F.aggregate("_p", F.lit(0.0), lambda s, v: s + v * v)
    pv = materialize(pts.groupBy(*keys).agg(F.max(F.struct(norm2.alias("_n"), F.col("_p"))).alias("_m")).select(
        *keys, F.col("_m._p").alias("_pv")), "pivots")
    # one small written row per cluster: every pivot, its radius, and the last farthest point
    ctx = None
    for i in range(passes):
        nxt = _farthest(pts, keys, pv, _vec_d2)
        own = pv.select(*keys, F.col("_pv").alias(f"_q{i}")).join(
            nxt.select(*keys, F.sqrt("_r2").alias(f"_R{i}")), keys)
        ctx = own if ctx is None else ctx.join(own, keys)
        pv = nxt
    # radii never decrease along the passes: L = d(last pivot, its farthest point)
    ctx = materialize(ctx.join(pv.select(*keys, F.col("_pv").alias("_v")), keys).withColumn(
        "_lb", F.col(f"_R{passes - 1}")).withColumn(
        "_m", F.zip_with(f"_q{passes - 1}", "_v", lambda a, b: (a + b) / 2)), "pivots")
    slack = F.lit(EPS) * (F.col("_lb") + F.lit(1.0))
    dist = F.array(*[F.sqrt(_vec_d2(F.col("_p"), F.col(f"_q{i}"))) for i in range(passes)])
    radii = F.array(*[F.col(f"_R{i}") for i in range(passes)])
    reach = F.forall(F.zip_with(dist, radii, lambda x, y: x + y), lambda s: s > F.col("_lb") - slack)
    out = F.sqrt(_vec_d2(F.col("_p"), F.col("_m"))) > F.col("_lb") / 2 - slack
    cand = materialize(pts.join(ctx, keys).filter(reach).select(*keys, "_p", out.alias("_out")), "diameter-candidates")
    number = cand.groupBy(*keys).agg(F.ceil(F.sum(F.size("_p").cast("long")) * 8 / BLOCK_BYTES).cast("int").alias("_n"))
    dealt = cand.join(number.withColumn("_n", F.greatest("_n", F.lit(1))), keys).withColumn(
        "_block", F.pmod(F.xxhash64("_p"), F.col("_n")).cast("int"))
    # a block meets itself and every other one
    met = dealt.select(*keys, "_p", "_out", "_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other")).select(
        *keys, F.least("_block", "_other").alias("_x"), F.greatest("_block", "_other").alias("_y"),
        (F.col("_block") > F.col("_other")).alias("_second"), "_p", "_out")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*keys).schema.fields)
    pairs = met.groupBy(*keys, "_x", "_y").applyInArrow(_block_pairs(keys), f"{fields}, _pair2 double").groupBy(*keys).agg(
        F.max("_pair2").alias("_pair2"))
    return (ctx.select(*keys, "_lb").join(pairs, keys, "left")
            .select(*keys, F.greatest(F.col("_lb"), F.sqrt(F.coalesce("_pair2", F.lit(0.0)))).alias("value")))


def _block_pairs(keys: list[str]):
    """For two blocks of a cluster: the largest squared distance of a pair with an endpoint outside the ball."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        flat = rows.column("_p").combine_chunks().flatten().to_numpy()
        points = flat.reshape(rows.num_rows, -1)
        out, second = (rows.column(c).to_numpy() for c in ("_out", "_second"))
        if second.any():
            a, b = points[~second], points[second]
            outside_a, outside_b = out[~second], out[second]
            best = max(farthest_pair(a[outside_a], b), farthest_pair(a[~outside_a], b[outside_b]))
        else:
            best = farthest_pair(points[out], points)
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in keys}, "_pair2": pa.array([best])})

    return run


def farthest_pair(a: np.ndarray, b: np.ndarray) -> float:
    """Largest squared distance between a row of ``a`` and one of ``b`` (0.0 without a pair).

    Products of whole blocks find the pairs that rounding leaves in question;
    these alone are measured coordinate by coordinate.
    """
    if not len(a) or not len(b):
        return 0.0
    # distances do not depend on the origin, the rounding of the products does
    origin = b.mean(axis=0)
    ca, cb = a - origin, b - origin
    na, nb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
    slack = EPS * (na.max() + nb.max())
    best, step = 0.0, max(1, PAIRS_AT_ONCE // len(b))
    for at in range(0, len(a), step):
        near = na[at:at + step, None] + nb - 2 * (ca[at:at + step] @ cb.T)
        # the largest first raises the bar for the others
        i, j = np.unravel_index(near.argmax(), near.shape)
        best = max(best, _exact(a[at + i:at + i + 1], b[j:j + 1]))
        rows, cols = np.nonzero(near > best - slack)
        for first in range(0, len(rows), PAIRS_AT_ONCE // 64):
            some = slice(first, first + PAIRS_AT_ONCE // 64)
            best = max(best, _exact(a[at + rows[some]], b[cols[some]]))
    return best


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += (a[:, k] - b[:, k])**2
    return float(total.max())
