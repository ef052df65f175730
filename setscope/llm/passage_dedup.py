"""Substring de-duplication of passages: a run of words that an earlier place of the corpus has goes, wherever it starts.

Unlike ``line_dedup`` it neither needs a repeated text to fill a line nor
takes short lines. Equal runs of ``least`` words share a mark, the smallest
hash among their shorter runs (winnowing), so only one place in about
``least`` / 4 is a row of the first search. Where a mark's surroundings are
equal too, all its runs are; only where they differ, at the ends of a common
passage, single runs are compared, by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from setscope.llm.joins import salted_join
from setscope.llm.text import chunks, release_worker_tables, split_words, word_hashes
from setscope.session import materialize

#: A passage has over 50 words.
LEAST = 51
#: Bytes of text worked on at once.
CHUNK = 2 << 20
#: Tasks that the places of one mark or run are spread over.
PARTS = 4

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Offsets of the texts' words, and both hashes of every word in lower case."""
    offsets, words = split_words(pc.utf8_lower(texts.fill_null("")))
    return offsets, tuple(map(_mixed, word_hashes(words)))


class _Sums:
    """Hashes of any run of the given word hashes, from their sums up to every place."""

    def __init__(self, hashes: np.ndarray, base: np.uint64):
        powers = np.full(len(hashes) + 1, base, dtype=np.uint64)
        back = np.full(len(hashes) + 1, _inverse(base), dtype=np.uint64)
        powers[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * np.cumprod(powers)[:-1])))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[begin]) * self.back[begin])


def _starts(offsets: np.ndarray, least: int) -> np.ndarray:
    """Places from which a run of ``least`` words stays in its text."""
    size = np.maximum(np.diff(offsets) - least + 1, 0)
    return np.repeat(offsets[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _marks(texts: pa.Array, least: int) -> tuple[np.ndarray, ...]:
    """(text, place in it, mark, around, again): the short run of smallest hash in each run of ``least`` words.

    ``around`` is a hash of all words that a run of ``least`` words with the
    mark can hold; ``again`` says that the text has the mark twice.
    """
    offsets, (one, two) = _hashed(texts)
    short = (least + 1) // 2
    starts = _starts(offsets, least)
    begin = np.arange(max(len(one) - short + 1, 0))
    values = _Sums(one, _BASES[0]).of(begin, begin + short)
    smallest, reach, left = begin, 1, least - short + 1
    while reach < left and len(starts):
        step = min(reach, left - reach)
        a, b = smallest[:-step], smallest[step:]
        smallest, reach = np.where(values[b] < values[a], b, a), reach + step
    place = np.unique(smallest[starts])
    text = np.searchsorted(offsets, place, side="right") - 1
    low, high = np.maximum(place - (least - short), offsets[text]), np.minimum(place + least, offsets[text + 1])
    around = _Sums(two, _BASES[1]).of(low, high) + (place - low).astype(np.uint64) * _BASES[0]
    mark = values[place]
    order = np.lexsort((mark, text))
    equal = (mark[order][1:] == mark[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.zeros(len(place), dtype=bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    return text, place - offsets[text], mark, _mixed(around ^ (high - low).astype(np.uint64)), again


def _mark_rows(docs: DataFrame, least: int) -> DataFrame:
    """(id, key, at, mark, around, again): the marks of every text."""
    schema = StructType([StructField("id", docs.schema["id"].dataType), StructField("key", LongType()),
                         StructField("at", IntegerType()), StructField("mark", LongType()),
                         StructField("around", LongType()), StructField("again", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                text, at, mark, around, again = _marks(part.column("text"), least)
                text = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(text), part.column("key").take(text), pa.array(at.astype(np.int32)),
                     pa.array(mark.view(np.int64)), pa.array(around.view(np.int64)), pa.array(again)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _run_rows(rows: DataFrame, least: int) -> DataFrame:
    """(id, key, at, d1, d2): every run of ``least`` words around one of the ``places`` of its text."""
    schema = StructType([StructField("id", rows.schema["doc"].dataType["doc_id"].dataType), StructField("key", LongType()),
                         StructField("at", IntegerType()), StructField("d1", LongType()), StructField("d2", LongType())])
    before = least - (least + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("places")))
            for part in chunks(batch, "text", CHUNK):
                offsets, hashes = _hashed(part.column("text"))
                places = part.column("places")
                marked = places.flatten().to_numpy() + np.repeat(offsets[:-1], pc.list_value_length(places).to_numpy())
                wanted = np.zeros(offsets[-1] + 1, dtype=np.int64)
                np.add.at(wanted, np.maximum(marked - before, 0), 1)
                np.add.at(wanted, marked + 1, -1)
                starts = _starts(offsets, least)
                starts = starts[np.cumsum(wanted)[starts] > 0]
                text = np.searchsorted(offsets, starts, side="right") - 1
                d1, d2 = (_Sums(h, b).of(starts, starts + least).view(np.int64) for h, b in zip(hashes, _BASES, strict=True))
                at, text = (starts - offsets[text]).astype(np.int32), pa.array(text)
                doc = part.column("doc")
                yield pa.RecordBatch.from_arrays(
                    [doc.field("doc_id").take(text), part.column("key").take(text), pa.array(at), pa.array(d1), pa.array(d2)],
                    names=schema.names)

    return rows.mapInArrow(run, schema)


def _with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, text, key, ...) of every row with the arrays of its text in ``places`` (id, key, ...), null where it has none."""
    found = places.withColumnsRenamed({"id": "found_id", "key": "found_key"})
    joined = rows.join(found, rows["doc"]["doc_id"].eqNullSafe(found["found_id"]) & (rows["key"] == found["found_key"]), "left")
    return joined.drop("found_id", "found_key")


def _met(marks: DataFrame, where: Column, rank: Column) -> DataFrame:
    """(id, key, at, later): marks whose runs an earlier text has all (later), and those whose runs must be compared.

    A mark's surroundings hold all its runs. So among marks of equal
    surroundings only those of the first text are to be compared, and these
    only if the mark has other surroundings too or the text has it again.
    """
    shared = marks.groupBy("mark").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo < hi").select("mark")
    marked = materialize(salted_join(marks, shared, ["mark"], where, "left_semi", PARTS), "passages_marked")
    classes = marked.groupBy("mark", "around").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.max("again").alias("again"))
    varied = (classes.groupBy("mark").agg(F.min("around").alias("lo"), F.max("around").alias("hi"))
              .where("lo < hi").select("mark", F.lit(True).alias("varied")))
    classes = (salted_join(classes, varied, ["mark"], F.col("around"), "left", PARTS)
               .withColumn("varied", F.col("varied").isNotNull()))
    alone = (classes.where((F.col("first") == F.col("last")) & (F.col("varied") | F.col("again")))
             .select("first.id", "first.key", "first.at", F.lit(False).alias("later")))
    several = classes.where(F.col("first") < F.col("last")).select("mark", "around", "first", "varied")
    met = salted_join(marked, several, ["mark", "around"], where, "inner", PARTS)
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    met = met.where(~own | F.col("varied") | F.col("again")).select("id", "key", "at", (~own).alias("later"))
    return materialize(alone.unionByName(met), "passages_met")


def dedup_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every row of ``docs`` as doc (its other columns), text (what stays), n_removed (words), removed.

    Words are runs without ASCII white space, compared in lower case. A word
    goes if it stands in a run of ``least`` words that an earlier text has
    (smaller doc_id, null last, then text hash), or the same text before that
    run begins. So what goes is still there at its first place, and a text
    without such a run stays as it is. ``removed`` holds the [start, end)
    code-point spans in the original text, with the white space behind a span
    that begins a line, else before it. A null text stays null; rows that
    repeat doc_id and text are one document and get the same result.
    """
    others = [docs[c] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("key"))
    where = F.xxhash64("id", "key", "at")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key", "at")
    met = _met(_mark_rows(rows.select(F.col("doc")["doc_id"].alias("id"), "key", "text"), least), where, rank)
    places = met.where(~F.col("later")).groupBy("id", "key").agg(F.collect_set("at").alias("places"))
    runs = _run_rows(_with_places(rows, places), least)
    firsts = (runs.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
              .where("first < last").select("d1", "d2", "first"))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    later = salted_join(runs, firsts, ["d1", "d2"], where, "inner", PARTS).where(~own | (F.col("at") >= F.col("first.at") + least))
    found = (met.where("later").select("id", "key", "at", F.lit(None).cast("int").alias("start"))
             .unionByName(later.select("id", "key", F.lit(None).cast("int").alias("at"), F.col("at").alias("start"))))
    gone = _with_places(rows, found.groupBy("id", "key").agg(F.collect_set("at").alias("marks"), F.collect_set("start").alias("starts")))
    schema = StructType([rows.schema["doc"], StructField("text", StringType()),
                         StructField("n_removed", IntegerType()), StructField("removed", _SPANS)])
    return gone.mapInArrow(lambda batches: _cut(batches, least), schema)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _spans(data: np.ndarray, marks: np.ndarray, starts: np.ndarray, least: int) -> tuple[int, list[tuple[int, int]]]:
    """(words, byte spans) of a text's runs of ``least`` words with one of ``marks`` or from ``starts`` on."""
    full = ~_SPACE[data]
    edges = np.diff(np.concatenate(([False], full, [False])).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    depth = np.zeros(len(begins) + 1, dtype=np.int64)
    np.add.at(depth, np.maximum(marks - (least - (least + 1) // 2), 0), 1)
    np.add.at(depth, np.minimum(marks + least, len(begins)), -1)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + least, -1)
    gone = np.concatenate(([False], np.cumsum(depth[:-1]) > 0, [False])).astype(np.int8)
    first, last = np.flatnonzero(np.diff(gone) == 1), np.flatnonzero(np.diff(gone) == -1) - 1
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        start, end = int(begins[a]), int(ends[b])
        if start == 0 or data[start - 1] == 0x0A:
            end = int(begins[b + 1]) if b + 1 < len(begins) else end
        else:
            start = int(ends[a - 1]) if a else start
        out.append((start, end))
    return int((last - first + 1).sum()), out


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    release_worker_tables()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            kept, n_removed, spans = [], [], []
            for text, marks, starts in zip(*(part.column(c).to_pylist() for c in ("text", "marks", "starts")), strict=True):
                if not marks and not starts:
                    kept.append(text)
                    n_removed.append(0)
                    spans.append([])
                    continue
                raw = text.encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                n, cuts = _spans(data, np.array(marks, dtype=np.int64), np.array(starts, dtype=np.int64), least)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                stay = [0, *(x for c in cuts for x in c), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(stay[::2], stay[1::2], strict=True)).decode())
                n_removed.append(n)
                spans.append([{"start": int(points[a]), "end": int(points[b])} for a, b in cuts])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(kept, pa.string()), pa.array(n_removed, pa.int32()), pa.array(spans, spans_type)],
                names=["doc", "text", "n_removed", "removed"])
