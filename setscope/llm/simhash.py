"""SimHash near-duplicates: fingerprints, a Gray-order index per masked pattern, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from setscope.llm import gray_index
from setscope.llm.components import connected_components
from setscope.llm.joins import salted_join
from setscope.llm.text import chunks, release_worker_tables, split_words
from setscope.session import materialize

BITS = 64
WIDTH = 4
MOST = 4
HASH_SEED = 42
#: Codes of one pattern that one task links at once; larger groups are dealt out as pairs of parts.
PART = 8192
#: Shingles whose hashes are counted at once.
COUNT_AT_ONCE = 1 << 17
#: Bytes of text worked on at once: every word is an object for a while.
CHUNK = 2 << 20


def fingerprints_of(offsets: np.ndarray, words: pa.Array, width: int = WIDTH) -> np.ndarray:
    """uint64 fingerprint of every text given as [offsets[i], offsets[i+1]) of ``words``.

    A bit is 1 if it is set in over half of the XXH64 values of the text's
    word shingles. A text of fewer than ``width`` words is one shingle, a text
    without words has fingerprint 0.
    """
    joined = b" ".join(words.cast(pa.binary()).to_pylist())
    end = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    begin = np.concatenate(([0], end[:-1] + 1))[:len(end)]
    number = np.diff(offsets)
    shingles = np.where(number > 0, np.maximum(number - width + 1, 1), 0)
    text = np.repeat(np.arange(len(number)), shingles)
    first = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + width, offsets[1:][text]) - 1
    counts = np.zeros((len(number), BITS), dtype=np.int64)
    for at in range(0, len(text), COUNT_AT_ONCE):
        some = slice(at, at + COUNT_AT_ONCE)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], HASH_SEED) for x, y in
                              zip(begin[first[some]].tolist(), end[last[some]].tolist(), strict=True)),
                             dtype="<u8", count=len(text[some]))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(text[some]) != 0)))
        counts[text[some][starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``rows`` with its ``text`` column replaced by ``fp``, the fingerprint as a (signed) long."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType([*kept, StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                offsets, words = split_words(pc.ascii_lower(part.column("text").fill_null("")))
                fps = fingerprints_of(offsets, words, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(fps)],
                                                 names=schema.names)

    return rows.mapInArrow(run, schema)


def pattern_masks(most: int) -> list[int]:
    """Masks of two of ``most + 2`` blocks of bits: codes at ``most`` or fewer bits agree on one of them."""
    edges = [round(k * BITS / (most + 2)) for k in range(most + 3)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(codes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) links that join the distinct ``fp`` of ``codes`` at ``most`` or fewer bits into components.

    The top nodes of the index are masked patterns, one shuffle key each: a
    code goes to every pattern it matches, and close codes meet in at least
    one. Below a pattern the task builds a Gray-order hierarchy. A pattern of
    more than ``PART`` codes is dealt out by hash into parts, and each pair of
    parts is a key of its own, so any size is searched whole and none grows a
    task. A task returns spanning links, not pairs.
    """
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in pattern_masks(most)])
    keyed = codes.select("fp", F.posexplode(masks).alias("mask_no", "mask")).select(
        "fp", F.xxhash64("mask_no", F.col("fp").bitwiseAND(F.col("mask"))).alias("pattern"))
    parts = (keyed.groupBy("pattern").count().where(F.col("count") > PART)
             .select("pattern", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (keyed.join(parts, "pattern", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .select("fp", "pattern", own.alias("own"), other.alias("other"))
             .select("fp", F.xxhash64("pattern", F.least("own", "other"), F.greatest("own", "other")).alias("key")))
    return (dealt.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_link_sorted(most), "a long, b long").distinct())


def _link_sorted(most: int):
    """Links within every run of equal keys of a sorted partition; only an unfinished run is held over."""
    def linked(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        code, rep = gray_index.link(fp.view(np.uint64), key, most)
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(rep.view(np.int64))],
                                          names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = key = np.zeros(0, dtype=np.int64)
        for batch in batches:
            fp = np.concatenate((fp, batch.column("fp").to_numpy()))
            key = np.concatenate((key, batch.column("key").to_numpy()))
            done = np.searchsorted(key, key[-1]) if len(key) else 0
            if done:
                yield linked(fp[:done], key[:done])
                fp, key = fp[done:], key[done:]
        if len(key):
            yield linked(fp, key)

    return run


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row: with the doc_id it tells rows apart that don't repeat each other."""
    return F.xxhash64(*[docs[c] for c in docs.columns])


def near_duplicates(docs: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """(doc_id, row_key, fp, component_id, group_fp) for every row of ``docs`` (doc_id, text, more).

    Lower-cases A-Z, fingerprints the word shingles and links fingerprints at
    ``most`` or fewer bits; component_id is the smallest doc_id of the
    component, group_fp one fingerprint that names it. Null and empty texts
    have fingerprint 0 and are linked like any other. A null doc_id never
    names a component unless all its ids are null (then null). Repeated rows
    stay, an empty table gives an empty result. Copies share a fingerprint and
    are one code in the index.
    """
    rows = docs.select("doc_id", row_key(docs).alias("row_key"), "text")
    marked = materialize(fingerprints(rows, width), "fingerprints")
    codes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    groups = connected_components(near_links(codes, most))
    named = codes.join(groups, codes["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("group_fp"))
    firsts = named.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    labels = named.select("fp", "group_fp").join(firsts, "group_fp")
    return salted_join(marked, labels, ["fp"], F.col("row_key")).select(*marked.columns, "component_id", "group_fp")


def keep_first(docs: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, its columns unchanged.

    The row with the smallest doc_id stays (null last); among rows of that id
    the one with the smallest hash, and one of rows that repeat each other.
    """
    found = near_duplicates(docs, width, most)
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    firsts = found.groupBy("group_fp").agg(rank.alias("first")).select(
        F.col("first")["doc_id"].alias("first_id"), F.col("first")["row_key"].alias("first_key"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row_key(docs).alias("key"))
    kept = rows.join(firsts, rows["doc"]["doc_id"].eqNullSafe(firsts["first_id"]) & (rows["key"] == firsts["first_key"]),
                     "left_semi")
    once = kept.groupBy(F.col("doc")["doc_id"].alias("id"), "key").agg(F.first("doc").alias("doc"))
    return once.select("doc.*")
