"""Phrase collocations by dynamic itemset counting over cyclic scans of shards.

The texts lie in a few shards that are scanned in turn, round and round. Words
count from the first scan on. A longer phrase becomes active as soon as the two
phrases one word shorter that it holds have both reached the threshold, is
counted from the next scan on, and is complete when every shard has been
scanned once since. So lengths overlap: phrases of two words are counted while
words still are, and so on. Every phrase that reaches the threshold becomes
active, because its parts reach it too, so its count is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setscope.llm.text import chunks, release_worker_tables
from setscope.session import materialize, release_tables, tables_of

LONGEST = 4
THRESHOLD = 30
TOP = 2000
SHARDS = 2
#: The texts of the frequent phrases are looked up in growing parts of each shard: 1, 3, 12 and 48 of 64 texts.
LOOKS = 4
UNKNOWN_LANG = "und"
#: A candidate goes if a longer one that holds it has at least so many hundredths of its count.
COVERED = 80
#: The score of a phrase that never stands without its parts, nor they without it.
FULL = 2_000_000
#: log2 of the bits of the filters that tasks test phrases with; fixed, whatever the number of phrases.
FILTER_BITS = 25
#: Bytes of text worked on at once.
CHUNK = 2 << 20

#: Fixed random factors of the bytes, and the base of the hashes (odd, so it has an inverse modulo 2**64).
_BYTE = np.random.default_rng(13).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE, _END = 32, 10
_STOPS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_GAPS = _STOPS | np.isin(np.arange(256), list(b" \t"))


class Slices:
    """64-bit hashes of slices of a byte array: differences of one running polynomial modulo 2**64."""

    _power = _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Slices._power) <= len(data):
            steps = np.full(len(data) + 1, _BASE, dtype=np.uint64)
            back = np.full(len(data) + 1, pow(_BASE, -1, 2**64), dtype=np.uint64)
            steps[0] = back[0] = 1
            Slices._power, Slices._inverse = np.cumprod(steps), np.cumprod(back)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * Slices._power[:len(data)], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * Slices._inverse[begin]


def _filter_bit(keys: np.ndarray, log_bits: int) -> np.ndarray:
    """The bit for phrase keys in a filter of 2**log_bits bits."""
    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - log_bits)).astype(np.int64)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a column of strings without nulls."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_utf8(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(
        np.ascontiguousarray(data))]).cast(pa.string())


def normalised(texts: pa.Array) -> pa.Array:
    """Texts as their pieces: A-Z in lower case, words one space apart, a line end after each piece; null: empty."""
    offsets, raw = _buffers(texts.fill_null(""))
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    # a text ends its last piece
    wide = np.insert(low, offsets[1:], _END)
    gap, stop = _GAPS[wide], _STOPS[wide]
    after_word = gap & ~np.concatenate(([True], gap[:-1]))
    # the gap after a word is a line end if a stop comes before the next word
    ends = np.flatnonzero(after_word)
    stops = np.concatenate(([0], np.cumsum(stop)))
    begins = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    following = np.append(begins[1:], len(wide))
    wide[ends] = np.where(stops[following] > stops[ends], _END, _SPACE)
    keep = ~gap | after_word
    place = np.concatenate(([0], np.cumsum(keep)))
    return _strings(place[np.concatenate(([0], offsets[1:] + np.arange(1, len(offsets))))], wide[keep])


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one occurrence of each, and their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), dtype=bool), keys[1:] != keys[:-1])))
    return keys[starts], order[starts], np.diff(np.append(starts, len(keys)))


class Words:
    """The words of normalised texts of one language, and the keys of the phrases they start."""

    def __init__(self, data: np.ndarray, salt):
        self.data, self.salt, self.slices = data, salt, Slices(data)
        self.end = np.flatnonzero((data == _SPACE) | (data == _END))
        self.begin = np.concatenate(([0], self.end[:-1] + 1))[:len(self.end)]

    def keys(self, first: np.ndarray, length: int) -> np.ndarray:
        """64-bit keys of the phrases of ``length`` words from the words ``first`` on, different by language."""
        return self.slices.hashes(self.begin[first], self.end[first + length - 1]) ^ self.salt

    def active(self, reached: np.ndarray, complete: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, first words) of the active phrases of two words and more.

        A phrase is active if both of its parts, its words but the last and
        but the first, are in the filter ``reached`` and not both in the
        filter ``complete``, which is the former one cycle ago. Filters only
        grow, so a phrase is active in the scans of one whole cycle; one that
        a filter takes for another starts its cycle early, no more.
        """
        log_bits = (8 * len(reached)).bit_length() - 1
        joined = self.data[self.end] == _SPACE
        part = np.arange(len(self.end))
        one = joined
        for length in range(2, longest + 1):
            at = _filter_bit(self.keys(part, length - 1), log_bits)
            now, done = np.zeros(len(self.end) + 1, dtype=bool), np.zeros(len(self.end) + 1, dtype=bool)
            now[part], done[part] = _has(reached, at), _has(complete, at)
            both = now[:-1] & now[1:] & joined
            yield length, np.flatnonzero(both & ~(done[:-1] & done[1:]))
            # all phrases of the length are parts, whatever became of theirs: a cycle begins by the filters alone
            part = np.flatnonzero(joined)
            joined = joined & np.append(one[length - 1:], np.zeros(min(length - 1, len(one)), dtype=bool))


def _sharded(docs: DataFrame) -> DataFrame:
    """(lang, text, part): normalised texts, dealt out evenly; written once. A shard is ``LOOKS`` parts, one a look."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col("text")).where(
        "text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        done = TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                turn, shard = np.divmod(done + np.arange(part.num_rows), SHARDS)
                look = np.searchsorted(4 ** np.arange(LOOKS - 1), turn % 4 ** (LOOKS - 1), side="right")
                done += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("lang"), normalised(part.column("text")),
                                                  pa.array((shard * LOOKS + look).astype(np.int32))],
                                                 names=["lang", "text", "part"])

    return materialize(rows.mapInArrow(run, "lang string, text string, part int"), "shards", partition_by="part")


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """The texts of a shard by language, a bounded number of bytes at once."""
    release_worker_tables()
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            langs = part.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, part.column("text").filter(pa.array(langs.indices.to_numpy() == i))


def _scan(shard: DataFrame, with_words: bool, filters, longest: int) -> DataFrame:
    """(key, words, n) of all words, if asked for, and all active phrases of a shard, per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            words = Words(_buffers(texts)[1], _salt(lang))
            found = [(1, np.arange(len(words.end)))] if with_words else []
            for length, first in [*found, *(words.active(*filters.value, longest) if filters is not None else ())]:
                keys, _, n = _distinct(words.keys(first, length))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(n), length, np.int8)),
                                                  pa.array(n.astype(np.int64))], names=["key", "words", "n"])

    return shard.select("lang", "text").mapInArrow(run, "key long, words tinyint, n long")


def _filter(keys: DataFrame) -> np.ndarray:
    """Filter of the ``key`` of a frame: at most 2**FILTER_BITS bits come to the driver, whatever the number of keys."""
    log_bits = FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log_bits - 3, dtype=np.uint8)
        for batch in batches:
            at = _filter_bit(batch.column("key").to_numpy().view(np.uint64), log_bits)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        words = bits.view("<i8")
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used])], names=["at", "bits"])

    rows = keys.select("key").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << log_bits - 6, dtype="<i8")
    bits[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return bits.view(np.uint8)


def phrase_counts(shards: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(key, words, n): exact counts of all words and phrases that reach the threshold.

    One step scans one shard and adds its counts to those of the phrases
    that are not complete; complete ones leave, the frequent ones to the
    result. Steps end when nothing new reached the threshold for a cycle.
    Each step's counts are written under spark.checkpoint.dir and given back
    after the next step.
    """
    spark, owner = shards.sparkSession, f"collocations {uuid.uuid4().hex}"
    ever = [np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)] * (SHARDS + 1)
    open_rows, done, step = None, [], 0
    while step < SHARDS or not np.array_equal(ever[-1], ever[-1 - SHARDS]):
        filters = spark.sparkContext.broadcast((ever[-1], ever[-1 - SHARDS])) if step else None
        with tables_of(f"{owner} {step}"):
            begin = step % SHARDS * LOOKS
            rows = _scan(shards.where(F.col("part").between(begin, begin + LOOKS - 1)), step < SHARDS, filters, longest).withColumn(
                "since", F.lit(step).cast("smallint"))
            rows = rows if open_rows is None else rows.unionByName(open_rows)
            # "since" is the first step with the phrase, never before its cycle began
            counted = materialize(rows.groupBy("key", "words").agg(F.sum("n").alias("n"), F.min("since").alias("since")), "open")
        frequent = counted.where(F.col("n") >= threshold)
        complete = F.col("since") <= step - SHARDS + 1
        done.append(materialize(frequent.where(complete).select("key", "words", "n"), "frequent"))
        ever.append(ever[-1] | _filter(frequent.where(F.col("words") < longest)))
        open_rows = counted.where(~complete)
        if step:
            filters.unpersist()
            release_tables(spark, f"{owner} {step - 1}")
        step += 1
    out = open_rows.where(F.col("n") >= threshold).select("key", "words", "n")
    for rows in done:
        out = out.unionByName(rows)
    return out


def _phrases_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, lang, phrase) of the phrases of some texts that may have one of the ``wanted`` keys, one row a key."""
    bits = texts.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_bits = (8 * len(bits.value)).bit_length() - 1
        seen = np.zeros(0, dtype=np.uint64)
        for lang, texts in _by_lang(batches):
            words = Words(_buffers(texts)[1], _salt(lang))
            joined = words.data[words.end] == _SPACE
            whole = np.ones(len(words.end), dtype=bool)
            for length in range(2, LONGEST + 1):
                if len(words.end) < length:
                    break
                whole = whole[:len(words.end) - length + 1] & joined[length - 2:len(words.end) - 1]
                first = np.flatnonzero(whole)
                keys = words.keys(first, length)
                hit = np.flatnonzero(_has(bits.value, _filter_bit(keys, log_bits)))
                keys, one, _ = _distinct(keys[hit])
                place = np.searchsorted(seen, keys)
                new = seen[np.minimum(place, len(seen) - 1)] != keys if len(seen) else np.ones(len(keys), dtype=bool)
                seen = np.insert(seen, place[new], keys[new])
                first = first[hit[one[new]]]
                begin, size = words.begin[first], words.end[first + length - 1] - words.begin[first]
                offsets = np.concatenate(([0], np.cumsum(size)))
                flat = words.data[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array([lang] * len(first), pa.string()),
                                                  _strings(offsets, flat)], names=["key", "lang", "phrase"])

    return texts.select("lang", "text").mapInArrow(run, "key long, lang string, phrase string").groupBy("key").agg(
        F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))


def _named(shards: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, words, n, lang, phrase) of the frequent phrases of two words and more, found in the texts once more.

    Each look reads a part three to four times as large as all before it, for the phrases still without a text. So
    a phrase comes from few places, however often it stands, and all looks together read the texts once.
    """
    out, wanted = None, counts.where("words > 1")
    for look in range(LOOKS):
        texts = shards.where(F.col("part").isin([shard * LOOKS + look for shard in range(SHARDS)]))
        found = materialize(wanted.join(_phrases_of(texts, wanted), "key"), "candidates")
        out = found if out is None else out.unionByName(found)
        if look < LOOKS - 1:
            wanted = materialize(wanted.join(found.select("key"), "key", "left_anti"), "wanted")
    return out


def _parts(candidates: DataFrame, cuts: bool) -> DataFrame:
    """The keys of what a candidate holds: both parts of its cuts (k, first, rest), or its inner phrases of two words and more (part)."""
    names = ("k", "first", "rest") if cuts else ("part",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(len(names) + 1)]
            for row, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
                words = Words(np.frombuffer(phrase.encode() + b"\n", dtype=np.uint8), _salt(lang))
                n = len(words.end)
                key = lambda i, k: int(words.keys(np.array([i]), k).view(np.int64)[0])
                found = [(k, key(0, k), key(k, n - k)) for k in range(1, n)] if cuts else \
                    [(key(i, k),) for k in range(2, n) for i in range(n - k + 1)]
                for one in found:
                    for column, value in zip(out, (row, *one), strict=True):
                        column.append(value)
            rows = batch.take(pa.array(out[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in out[1:])],
                                             names=[*rows.schema.names, *names])

    schema = ", ".join(["key long, words tinyint, n long, lang string, phrase string", *(f"{x} long" for x in names)])
    return candidates.select("key", "words", "n", "lang", "phrase").mapInArrow(run, schema)


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language.

    ``docs`` has text and lang; a null lang is ``und``, a null or empty text
    has no words, repeated rows count as often as they stand, an empty table
    gives an empty result, and other columns play no part. a, l and r are
    the counts of the phrase and of its parts at the cut with the lowest
    score floor(2000000 a / (l + r)), the first of equal ones; n counts all
    words of the language. Phrases that a longer candidate covers go.

    Phrases are counted by 64-bit keys (hash of the language and the words);
    the texts of the frequent ones are read back in one more scan. Counts
    combine in the tasks and map-side, so a phrase or language that a third
    of the corpus holds arrives as one row per chunk; ranks are limited
    before the shuffle by language.
    """
    shards = _sharded(docs)
    counts = materialize(phrase_counts(shards, threshold), "counts")
    candidates = _named(shards, counts)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    covers = _parts(candidates.where("words > 2"), False).groupBy("part").agg(F.max("n").alias("cover"))
    kept = candidates.join(covers, candidates["key"] == covers["part"], "left").where(
        F.col("cover").isNull() | (exact("cover") * 100 < exact("n") * COVERED))
    left = counts.select(F.col("key").alias("first"), F.col("n").alias("l"))
    right = counts.select(F.col("key").alias("rest"), F.col("n").alias("r"))
    scored = _parts(kept, True).join(left, "first").join(right, "rest").withColumnRenamed("n", "a").withColumn(
        "score", F.expr(f"cast({FULL} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)"))
    lowest = scored.groupBy("key", "lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # every word of a normalised text has one byte of gap behind it
    words = shards.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit("[ \\n]")).cast("long")).alias("all"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                           F.col("all").alias("n"), "score")
