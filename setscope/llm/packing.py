"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Documents above a third of the capacity are matched greedily, at most two to a
sequence; smaller ones go, longest first, into the smallest gap that holds them.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from setscope.llm.text import WordTable, chunks, split_words, worker_table
from setscope.session import materialize

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text worked on at once.
CHUNK = 2 << 20
#: Parts that the pieces of one length are numbered in.
PARTS = 256


class TokenTable(WordTable):
    """Ids of every distinct word. White space ends a token of this tokenizer, so a text's ids are its words' ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: at most about 2**23 ids of kept words, so an int32 tells their place
        self.ids = np.zeros(0, dtype="<u4")
        super().__init__(self._encode, limit=32 << 20)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, ...]:
        found = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), "<u4", int(length.sum()))
        # ids behind those of the kept words belong to an earlier batch
        kept = int(self.table[0].sum()) if self.table else 0
        self.ids = np.concatenate((self.ids[:kept], flat))
        return length.astype(np.int32), (kept + np.cumsum(length) - length).astype(np.int32)

    def full(self) -> bool:
        return super().full() or self.ids.nbytes >= self.limit

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, each closed by ``end_id``."""
        offsets, words = split_words(texts)
        if len(words):
            rows, (length, first) = self.lookup(words)
            n, first = length[rows].astype(np.int64), first[rows].astype(np.int64)
        else:
            n = first = np.zeros(0, dtype=np.int64)
        before = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(first - before[:-1], n) + np.arange(before[-1])]
        ends = before[offsets]
        return ends + np.arange(len(ends)), np.insert(ids, ends[1:], end_id).astype("<u4", copy=False)


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document is the ids of its whole text (null: none) and ``end_id``;
    longer ones are cut every ``capacity`` ids. ``tokenizer`` is a file name
    of the public tokenizers folder.
    """
    fields = [docs.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()),
              StructField("length", LongType()), StructField("ids_crc32", LongType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(LongType())))
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = public_tokenizers.path(tokenizer)
        table = worker_table(f"tokens {path}", lambda: TokenTable(path))
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                offsets, ids = table.encode(part.column("text"), end_id)
                size = np.diff(offsets)
                number = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = offsets[:-1][doc] + start
                data = ids.tobytes()
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.append(at, at[-1] + length[-1]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Bins:
    """Sequences by the gap they have left, as runs of consecutive sequence numbers."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.open = np.zeros(capacity + 1, dtype=bool)
        self.placed: dict[int, int] = {}
        self.plan: list[tuple[int, int, int, int, int]] = []

    def new(self, n: int) -> tuple[int, int]:
        self.next += n
        return self.next - n, n

    def put(self, length: int, run: tuple[int, int], gap: int, each: int = 1) -> int:
        """``each`` pieces of ``length`` into every sequence of ``run``; returns the gap left."""
        first = self.placed.get(length, 0)
        self.plan.append((length, first, run[0], each, self.capacity - gap))
        self.placed[length] = first + run[1] * each
        return gap - length * each

    def leave(self, run: tuple[int, int], gap: int) -> None:
        if run[1] and gap:
            self.runs.setdefault(gap, []).append(run)
            self.open[gap] = True

    def fill(self, length: int, count: int) -> None:
        """Best fit of ``count`` equal pieces: the smallest gap first, a sequence filled before the next is touched."""
        while count:
            at = length + int(self.open[length:].argmax())
            if not self.open[at]:
                at = self.capacity
                run = self.new(-(-count // (at // length)))
            else:
                run = self.runs[at].pop()
                self.open[at] = bool(self.runs[at])
            each = at // length
            full = min(run[1], count // each)
            if full:
                self.leave((run[0], full), self.put(length, (run[0], full), at, each))
                count -= full * each
            rest = (run[0] + full, run[1] - full)
            if rest[1] and count:
                self.leave((rest[0], 1), self.put(length, (rest[0], 1), at, count))
                rest, count = (rest[0] + 1, rest[1] - 1), 0
            self.leave(rest, at)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, rank, sequence, each, offset) that place all pieces, given how many have each length.

    From ``rank`` on (up to the next row of the length), ``each`` pieces of
    the length go one after the other from ``offset`` in consecutive
    sequences from ``sequence`` on. The work depends on the number of
    lengths (``capacity`` at most), not of pieces.
    """
    left = {k: n for k, n in counts.items() if n}
    bins = _Bins(capacity)
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_right(large, min(a, capacity - a)) - 1
        if at >= 0 and large[at] == a and left[a] == 1:
            at -= 1
        b = large[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        run = bins.new(n)
        gap = bins.put(a, run, capacity)
        left[a] -= n
        if b is not None:
            gap = bins.put(b, run, gap)
            left[b] -= n
        bins.leave(run, gap)
        large = [k for k in large if left[k]] if not (left[a] and (b is None or left[b])) else large
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        bins.fill(k, left[k])
    return np.array(sorted(bins.plan), dtype=np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: from 0 within each length.

    The pieces of a length are numbered in ``PARTS`` parts dealt by hash, each
    after the counts of the parts before it, so a length that a third of all
    pieces have is no single task.
    """
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int"))
    before = (dealt.groupBy("length", "part").count().select(
        F.col("length").alias("l"), F.col("part").alias("p"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before")))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = dealt.withColumn("own", own)
    return numbered.join(before, (numbered["length"] == before["l"]) & (numbered["part"] == before["p"])).select(
        *pieces.columns, (F.col("before") + F.col("own")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece in its sequence.

    Null and empty texts are documents of ``end_id`` alone; repeated rows and
    null ids are packed like any other row; an empty table gives an empty
    result. Only the number of pieces of each length (``capacity`` rows at
    most) comes to the driver, which plans by runs of sequences; the plan,
    bounded by the number of lengths too, goes back to the tasks.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = docs.sparkSession.sparkContext.broadcast(packing_plan(counts, capacity))
    columns = pieces.columns
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, each, offset = plan.value.T
        keys = (length << 44) + first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(keys, (own << 44) + rank, side="right") - 1
            over = rank - first[row]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence[row] + over // each[row]),
                 pa.array(offset[row] + over % each[row] * own)], names=schema.names)

    return _ranked(pieces).mapInArrow(run, schema)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, in order of their pieces."""
    placed = pack(docs, with_ids=True, **options)
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(
        F.struct("offset", "doc_id", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.col("p")["ids"]).alias("ids"), F.col("p")["doc_id"].alias("doc_ids"))
