"""Hard-negative mining with rotated one-bit codes and certain score intervals.

Every vector is stored as a few one-bit codes: the signs of the vector under a
fixed rotation, the alignment of the vector with that code vector, and then the
same for the residual under the next rotation. The inner product of an anchor
and a code vector comes from popcounts of the code with the bit planes of the
rotated, quantised anchor; what the codes leave out is bounded by
Cauchy-Schwarz on the last residual, so every pair has an interval that
certainly holds its score. Pairs whose interval cannot matter are dropped, the
others are scored in integers: the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.llm.topk import usable
from setscope.session import materialize

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Codes of a vector, and bit planes of a rotated anchor.
LEVELS = 7
PLANES = 8
ROTATION_SEED = 11
#: Expected rows and anchors of one block; a task holds one pair of blocks.
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 2048
#: Pairs of a block whose intervals are held at once.
PAIRS_AT_ONCE = 1 << 20
#: One of so many rows gives the first cutoffs of the negatives.
FIRST_LOOK = 8
EXACT = 2.0**53
#: Share of |a||b| that covers the rounding of an interval.
SLACK = 1e-9

_CODED = "vec_id long, label string, row_key long, anchor boolean, vector binary, codes binary, align binary"


def rotations(width: int, levels: int = LEVELS) -> np.ndarray:
    """``levels`` fixed orthogonal matrices; which ones changes the time, not the result."""
    return np.stack([np.linalg.qr(np.random.default_rng([ROTATION_SEED, k]).standard_normal((width, width)))[0]
                     for k in range(levels)])


def one_bit_codes(x: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes: rows x levels x 64-bit words, align: rows x (levels + 1)) of the rows of ``x``.

    Level k holds the signs of the k-th rotation of what the levels before it
    left, and its alignment with that unit code vector; the last column is
    the norm of what all levels leave.
    """
    n, width = x.shape
    words = -(-width // 64)
    codes = np.zeros((n, len(turns), words), dtype=np.uint64)
    align = np.zeros((n, len(turns) + 1))
    rest = x.astype(np.float64)
    for k, turn in enumerate(turns):
        turned = rest @ turn.T
        positive = turned >= 0
        packed = np.packbits(np.pad(positive, ((0, 0), (0, words * 64 - width))), axis=1, bitorder="little")
        codes[:, k] = packed.view("<u8")
        unit = np.where(positive, 1.0, -1.0) / math.sqrt(width)
        align[:, k] = np.einsum("ij,ij->i", turned, unit)
        rest = rest - align[:, k, None] * (unit @ turn)
    align[:, -1] = np.linalg.norm(rest, axis=1)
    return codes, align


def intervals(anchors: np.ndarray, codes: np.ndarray, align: np.ndarray, norms: np.ndarray,
              turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), anchors x rows: bounds that certainly hold the inner products.

    A rotated anchor is ``base + step * u`` with ``PLANES``-bit u per
    component, so its product with a code vector is a sum of popcounts of
    the code and the planes of u, up to half a step per component. With unit
    code vectors c_k, alignments a_k and the last residual r (orthogonal to
    the last c), <q, x> = sum a_k <q, c_k> + <q, r> and
    |<q, r>| <= |r| sqrt(|q|^2 - <q, c_last>^2).
    """
    n, width, words = len(anchors), anchors.shape[1], codes.shape[2]
    root = math.sqrt(width)
    norm = np.linalg.norm(anchors, axis=1)
    middle, spread = np.zeros((n, len(codes))), np.zeros((n, len(codes)))
    ones = np.bitwise_count(codes).sum(axis=2, dtype=np.int64)
    for k, turn in enumerate(turns):
        turned = anchors @ turn.T
        base = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - base) / (2**PLANES - 1), np.finfo(float).tiny)
        u = np.clip(np.rint((turned - base[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint8)
        left = np.abs(turned - (base[:, None] + step[:, None] * u)).sum(axis=1) / root
        counted = np.zeros((n, len(codes)), dtype=np.int32)
        for plane in range(PLANES):
            bits = np.packbits(np.pad((u >> plane) & 1, ((0, 0), (0, words * 64 - width))), axis=1, bitorder="little").view("<u8")
            for w in range(words):
                counted += np.bitwise_count(bits[:, None, w] & codes[None, :, k, w]).astype(np.int32) << plane
        total = base * width + step * u.sum(axis=1)
        product = (2 * (base[:, None] * ones[None, :, k] + step[:, None] * counted) - total[:, None]) / root
        middle += align[None, :, k] * product
        spread += np.abs(align[None, :, k]) * left[:, None]
    sure = np.maximum(np.abs(product) - left[:, None], 0.0)
    spread += align[None, :, -1] * np.sqrt(np.maximum(norm[:, None]**2 - sure**2, 0.0))
    spread += SLACK * norm[:, None] * norms[None, :]
    return middle - spread, middle + spread


def _encode(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rotations(width)
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(size), width))
            x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            codes, align = one_bit_codes(x, turns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("row_key"), batch.column("anchor"),
                 *(pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, codes, align))],
                names=["vec_id", "label", "row_key", "anchor", "vector", "codes", "align"])

    return run


def _block(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = -(-width // 64)
    read = lambda c, kind: np.frombuffer(b"".join(frame[c]), dtype=kind)
    return (read("vector", np.float64).reshape(-1, width), read("codes", np.uint64).reshape(-1, LEVELS, words),
            read("align", np.float64).reshape(-1, LEVELS + 1))


def _scores(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows a of ``q`` with the rows b of ``x``; Python integers where they need it."""
    if len(a) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        whole = np.vectorize(int, otypes=[object])
        return (whole(q[a]) * whole(x[b])).sum(axis=1)
    out = np.zeros(len(a), dtype=np.int64)
    for at in range(0, len(a), PAIRS_AT_ONCE // 16):
        some = slice(at, at + PAIRS_AT_ONCE // 16)
        out[some] = np.einsum("ij,ij->i", q[a[some]], x[b[some]]).astype(np.int64)
    return out


def _least_of_best(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th largest allowed value; minus infinity where fewer are allowed."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(allowed, values, -np.inf), values.shape[1] - k, axis=1)[:, values.shape[1] - k]


_PAIR = "anchor_key long, anchor_id long, vec_id long, score string"


def _positives(width: int, k: int):
    """The k best rows of each anchor's own label within a block."""
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            (x, codes, align), (q, _, _) = _block(rows, width), _block(anchors, width)
            turns, norms, ids = rotations(width), np.linalg.norm(x, axis=1), rows["vec_id"].to_numpy()
            label, own = rows["label"].to_numpy(), anchors["label"].to_numpy()
            size = max(1, PAIRS_AT_ONCE // len(rows))
            for at in range(0, len(anchors), size):
                some = slice(at, at + size)
                low, high = intervals(q[some], codes, align, norms, turns)
                same = (own[some, None] == label[None]) & (anchors["vec_id"].to_numpy()[some, None] != ids[None])
                a, b = np.nonzero(same & (high >= _least_of_best(low, same, k)[:, None]))
                scores = _scores(q, x, a + at, b)
                begins = np.searchsorted(a, np.arange(len(same) + 1))
                for i in range(len(same)):
                    of = slice(begins[i], begins[i + 1])
                    best = sorted((-int(s), int(v)) for s, v in zip(scores[of], ids[b[of]], strict=True))[:k]
                    out += [(anchors["row_key"].iat[at + i], anchors["vec_id"].iat[at + i], v, str(-n)) for n, v in best]
        return pd.DataFrame(out, columns=["anchor_key", "anchor_id", "vec_id", "score"])

    return run


def _windows(scores: pd.Series, low: int, high: int) -> list[tuple[int, int]]:
    """Least and largest integer score of a negative for each positive's score."""
    return [(-(-low * int(s) // 100), high * int(s) // 100) for s in scores]


def _negatives(width: int, k: int, low_share: int, high_share: int):
    """The k best rows of other labels in each positive's window within a block."""
    names = ["anchor_key", "place", "vec_id", "score"]

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            (x, codes, align), (q, _, _) = _block(rows, width), _block(anchors, width)
            turns, norms, ids = rotations(width), np.linalg.norm(x, axis=1), rows["vec_id"].to_numpy()
            label, own = rows["label"].to_numpy(), anchors["label"].to_numpy()
            # one line per anchor and positive: the scores it takes, at least its cutoff so far
            listed = [(i, p) for i, ps in enumerate(anchors["positives"]) for p in ps]
            line = np.array([i for i, _ in listed], dtype=np.int64)
            ends = [(max(-(-low_share * int(p["score"]) // 100), int(p["cutoff"] or -2**2000)),
                     high_share * int(p["score"]) // 100) for _, p in listed]
            # as floats they may be off by a rounding: widened by it
            least, most = (np.array([max(min(float(e[i]), 1e308), -1e308) for e in ends]) for i in (0, 1))
            least, most = least - 1e-12 * np.abs(least), most + 1e-12 * np.abs(most)
            size = max(1, PAIRS_AT_ONCE // len(rows))
            for at in range(0, len(anchors), size):
                low, high = intervals(q[at:at + size], codes, align, norms, turns)
                other = own[at:at + size, None] != label[None]
                wanted = np.zeros(other.shape, dtype=bool)
                lines = np.flatnonzero((line >= at) & (line < at + size))
                for begin in range(0, len(lines), size):
                    part = lines[begin:begin + size]
                    i, lo, hi = line[part] - at, least[part, None], most[part, None]
                    # certain members of the window give a bar, which rows below it cannot pass
                    inside = other[i] & (low[i] >= lo * (1 + 2e-12 * np.sign(lo))) & (high[i] <= hi * (1 - 2e-12 * np.sign(hi)))
                    bar = np.maximum(_least_of_best(low[i], inside, k)[:, None], lo)
                    first = np.flatnonzero(np.concatenate(([True], np.diff(i) != 0)))
                    wanted[i[first]] |= np.logical_or.reduceat(other[i] & (high[i] >= bar) & (low[i] <= hi), first, axis=0)
                a, b = np.nonzero(wanted)
                scores = _scores(q, x, a + at, b)
                begins = np.searchsorted(a, np.arange(len(other) + 1))
                for j in lines:
                    of = slice(begins[line[j] - at], begins[line[j] - at + 1])
                    s = scores[of]
                    fits = np.flatnonzero([ends[j][0] <= v <= ends[j][1] for v in s] if s.dtype == object else
                                          (s >= max(ends[j][0], -2**63)) & (s <= min(ends[j][1], 2**63 - 1)))
                    if len(fits) > k and s.dtype != object:
                        fits = fits[s[fits] >= np.partition(s[fits], len(fits) - k)[len(fits) - k]]
                    best = sorted((-int(s[f]), int(ids[b[of][f]])) for f in fits)[:k]
                    out += [(anchors["row_key"].iat[line[j]], listed[j][1]["place"], v, str(-n)) for n, v in best]
        return pd.DataFrame(out, columns=names)

    return run


def _by_score(*keys: str):
    """Window over exact integers given as text: the largest first, ties by smaller vec_id."""
    below, digits = F.col("score").startswith("-"), F.length("score")
    return Window.partitionBy(*keys).orderBy(
        F.when(below, -digits).otherwise(digits).desc(), F.when(~below, F.col("score")).desc_nulls_last(),
        F.when(below, F.col("score")).asc_nulls_first(), "vec_id")


def _clipped(score: Column) -> Column:
    return F.coalesce(score.try_cast("long"), F.when(score.startswith("-"), F.lit(-2**63)).otherwise(F.lit(2**63 - 1)))


def _floored(v: Column) -> Column:
    """floor(256 v) as a double, exact; large doubles are whole already."""
    scaled = F.lit(float(SCALE)) * v.cast("double")
    return F.when(F.abs(scaled) < F.lit(2.0**52), F.floor(scaled).cast("double")).otherwise(scaled)


def _every(n) -> Column:
    return F.explode(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1))


def _coded(vectors: DataFrame, is_anchor: Column, label: Column) -> tuple[DataFrame, int]:
    """The stored index: one row per distinct (vec_id, label, vector) with codes and alignments; and the width."""
    rows = (vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"),
                    F.transform("embedding", _floored).alias("vector"), is_anchor.alias("anchor"))
            .where(F.col("label").isNotNull() & usable(F.col("vector")))
            .withColumn("row_key", F.xxhash64("vec_id", "label", "vector"))
            .groupBy("row_key", "vec_id", "label").agg(
                F.first("vector").alias("vector"), F.max(F.coalesce("anchor", F.lit(False))).alias("anchor")))
    rows = materialize(rows.select("vec_id", "label", "row_key", "anchor", "vector"), "vectors")
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 1, 1)
    return materialize(rows.mapInArrow(_encode(width), _CODED), "codes"), width


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    A component x counts as floor(256 x), a score is the integer inner
    product; higher scores come first, ties by smaller vec_id. The positives
    of an anchor are its ``positives`` best rows of the same label and
    another vec_id; for each, the ``negatives`` best rows of another label
    with low * positive_score <= 100 * negative_score <= high *
    positive_score are returned (none for a negative positive_score).

    Rows with a null vec_id, label or vector, or a null or non-finite
    component (also after scaling), take no part; a shorter vector counts as
    ending in zeros; rows that repeat vec_id, label and vector count once; a
    vec_id with several vectors is as many rows, and anchors, under one id.
    Scores outside a long are compared exactly and returned as its ends. An
    empty table gives an empty result; other columns play no part.

    Codes, alignments and scaled vectors are written once. Anchors meet the
    rows of their label (positives), then all rows (negatives), in blocks of
    bounded expected size dealt by hash, so no label, anchor or copy gathers
    in one task. A look at one of ``FIRST_LOOK`` rows gives each positive a
    cutoff, and a block returns at most k rows that reach it.
    """
    coded, width = _coded(vectors, is_anchor, F.col("label") if label is None else label)
    n_rows, n_anchors = coded.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    blocks_of = lambda n, size: max(1, math.ceil(n / size))

    # positives: a group holds whole labels, and is cut into blocks by its counts
    dealt = coded.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(blocks_of(n_rows, BLOCK_ROWS))))
    counted = dealt.groupBy("group").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rbs"),
        F.greatest(F.ceil(F.count(F.when(F.col("anchor"), 1)) / BLOCK_ANCHORS), F.lit(1)).cast("int").alias("abs"))
    placed = dealt.join(counted, "group")
    in_block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row_key"), n).cast("int")
    rows = placed.select("group", "vec_id", "label", "vector", "codes", "align",
                         in_block("row", F.col("rbs")).alias("rb"), _every(F.col("abs")).alias("ab"))
    # both sides come from one table: new names tell their columns apart
    asked = placed.where("anchor").select(
        *(F.col(c).alias(c) for c in ("group", "vec_id", "label", "row_key", "vector", "codes", "align")),
        in_block("anchor", F.col("abs")).alias("ab"), _every(F.col("rbs")).alias("rb"))
    near = rows.groupBy("group", "rb", "ab").cogroup(asked.groupBy("group", "rb", "ab")).applyInPandas(
        _positives(width, positives), _PAIR)
    ranked = near.withColumn("place", F.row_number().over(_by_score("anchor_key"))).where(F.col("place") <= positives)
    best = materialize(ranked.join(coded.where("anchor").select("row_key", "label", "vector", "codes", "align"),
                                   F.col("anchor_key") == F.col("row_key")), "positives")

    # negatives: a first look at some rows for cutoffs, then all rows
    def look(some: DataFrame, expected: float, cutoffs: DataFrame) -> DataFrame:
        rbs, abs_ = blocks_of(expected, BLOCK_ROWS), blocks_of(n_anchors, BLOCK_ANCHORS)
        found = F.struct("place", "score", "cutoff")
        anchors = best.join(cutoffs, ["anchor_key", "place"], "left").groupBy("row_key").agg(
            *(F.first(c).alias(c) for c in ("label", "vector", "codes", "align")), F.collect_list(found).alias("positives"))
        rows = some.select("vec_id", "label", "vector", "codes", "align",
                           in_block("row", F.lit(rbs)).alias("rb"), _every(abs_).alias("ab"))
        asked = anchors.withColumn("ab", in_block("anchor", F.lit(abs_))).withColumn("rb", _every(rbs))
        pairs = rows.groupBy("rb", "ab").cogroup(asked.groupBy("rb", "ab")).applyInPandas(
            _negatives(width, negatives, low, high), "anchor_key long, place int, vec_id long, score string")
        return pairs.withColumn("rank", F.row_number().over(_by_score("anchor_key", "place"))).where(F.col("rank") <= negatives)

    nothing = best.select("anchor_key", "place", F.lit(None).cast("string").alias("cutoff")).limit(0)
    some = coded.where(in_block("look", F.lit(FIRST_LOOK)) == 0)
    cutoffs = materialize(look(some, n_rows / FIRST_LOOK, nothing).where(F.col("rank") == negatives).select(
        "anchor_key", "place", F.col("score").alias("cutoff")), "cutoffs")
    found = look(coded, n_rows, cutoffs).select("anchor_key", "place", "rank", F.col("vec_id").alias("negative_id"),
                                                F.col("score").alias("negative"))
    of = best.select("anchor_key", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive"))
    return found.join(of, ["anchor_key", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        _clipped(F.col("positive")).alias("positive_score"), _clipped(F.col("negative")).alias("negative_score"))
