"""Quality rules: fixed base counts, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from setscope.llm import logistic
from setscope.llm.folds import labelled_texts
from setscope.llm.grams import char_grams, mixed, word_hashes
from setscope.llm.text import WordTable, chunks, split_words, sums, worker_table

#: Labelled documents of each label that the model is fitted on, at most; a fifth of them calibrates it.
PER_CLASS = 2000
BUCKETS = 1 << 15
CHAR_SIZES = (1, 2, 3)
SCALE = 10.0
LEAST_WORDS = 50
MOST_REPEATED = 50
THRESHOLD = 0.5
SYMBOLS = r"[#*$%&|<>]"
_WHITE = " \t\n\x0b\x0c\r"


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def _pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mixed(first, second) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row of a text: shares of its words, word pairs and character n-grams, three ranges of buckets."""
    total = np.zeros(3 * BUCKETS)
    if words:
        distinct, code = np.unique(np.array(words, dtype=object), return_inverse=True)
        hashes = word_hashes(distinct.tolist())
        count = np.bincount(code)
        np.add.at(total, _word_buckets(hashes), count / len(words))
        if len(words) > 1:
            np.add.at(total, BUCKETS + _pair_buckets(hashes[code[:-1]], hashes[code[1:]]), 1 / (len(words) - 1))
        of, bucket = char_grams(distinct.tolist(), CHAR_SIZES, BUCKETS)
        np.add.at(total, 2 * BUCKETS + bucket, count[of] / count[of].sum())
    index = np.flatnonzero(total)
    return index, SCALE * total[index]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Model fitted on labels.quality of a bounded sample; None if there are no documents of both labels.

    The classes weigh as all their labels do, so the calibrated probability
    is that of the labelled rows. Features are made in Spark; the sparse rows
    of the sample come to the driver.
    """
    rows, counts = labelled_texts(docs, labels, "quality", per_class, learn_only=False, seed="quality")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                offsets, words = split_words(part.column("text"))
                words = words.to_pylist()
                found = [features(words[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"),
                     pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                     pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                    names=["doc_id", "label", "index", "value"])

    got = rows.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(
        made, StructType([docs.schema["doc_id"], *StructType.fromDDL("label int, index array<int>, value array<float>").fields]))
    table = got.toArrow().sort_by("doc_id").combine_chunks()
    y = table["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    sampled = {v: (y == v).sum() for v in (0, 1)}
    weight = np.where(y == 1, counts[1] / sampled[1], counts[0] / sampled[0])
    index, value = (table[c].combine_chunks() for c in ("index", "value"))
    size = pc.list_value_length(index).to_numpy()
    flat_i, flat_v = index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float)
    row = np.repeat(np.arange(len(y)), size)
    judge = np.arange(len(y)) % 5 == 0
    if len(set(y[judge])) < 2 or len(set(y[~judge])) < 2:
        judge[:] = False
    use = ~judge[row]
    w, b = logistic.fit(np.concatenate(([0], np.cumsum(size[~judge]))), flat_i[use], flat_v[use], y[~judge],
                        weight[~judge], 3 * BUCKETS)
    z = np.bincount(row, weights=flat_v * w[flat_i], minlength=len(y)) + b
    some = judge if judge.any() else np.ones(len(y), dtype=bool)
    a, c = logistic.calibrate(z[some], y[some], weight[some])
    return {"key": uuid.uuid4().hex, "w": w * SCALE, "b": b, "a": a, "c": c}


def _word_table(model: dict) -> WordTable:
    """For every word: its hash, its weight, and the number and summed weight of its character n-grams."""
    w = model["w"]

    def compute(words: list[str]) -> tuple[np.ndarray, ...]:
        hashes = word_hashes(words)
        of, bucket = char_grams(words, CHAR_SIZES, BUCKETS)
        return (hashes, w[_word_buckets(hashes)], np.bincount(of, minlength=len(words)).astype(np.int64),
                np.bincount(of, weights=w[2 * BUCKETS + bucket], minlength=len(words)))

    return WordTable(compute)


def probabilities(offsets: np.ndarray, words: pa.Array, model: dict, table: WordTable) -> np.ndarray:
    """Calibrated probability of quality 1 of each text; the linear score is summed from word to text."""
    if not len(words):
        return logistic.sigmoid(np.full(len(offsets) - 1, model["a"] * model["b"] + model["c"]))
    rows, (hashes, weight, grams, gram_weight) = table.lookup(words)
    n = np.maximum(np.diff(offsets), 1)
    score = sums(weight[rows], offsets) / n + sums(gram_weight[rows], offsets) / np.maximum(sums(grams[rows], offsets), 1)
    pair = np.append(model["w"][BUCKETS + _pair_buckets(hashes[rows[:-1]], hashes[rows[1:]])], 0.0)
    pair[offsets[1:][np.diff(offsets) > 0] - 1] = 0
    score += sums(pair, offsets) / np.maximum(n - 1, 1)
    return logistic.sigmoid(model["a"] * (score + model["b"]) + model["c"])


def repeated_words(code: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more in a text of word codes."""
    if len(code) < 4:
        return 0
    base = int(code.max()) + 1
    pair = np.unique(code[:-1] * base + code[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * base + code[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(code), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality, base_failed, kept) per row.

    ``quality`` is the calibrated probability of label 1, and a text that
    passes the base rules is kept if it reaches ``threshold``; without a model
    the base rules alone decide and quality is null. A null or empty text has
    no words and fails. Repeated rows and null ids are judged like any other;
    further columns are not read; an empty table gives an empty result.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in counts),
                         StructField("quality", DoubleType()), StructField("base_failed", BooleanType()),
                         StructField("kept", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(f"quality {model['key']}", lambda: _word_table(model)) if model else None
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").fill_null("")
                offsets, words = split_words(texts)
                code = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
                n = np.diff(offsets)
                chars = sums(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64)
                lines = np.array([repeated_lines(t) for t in texts.to_pylist()], dtype=np.int64)
                repeated = np.array([repeated_words(code[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
                                    dtype=np.int64)
                failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
                quality = probabilities(offsets, words, model, table) if model else np.full(len(n), np.nan)
                kept = ~failed & (quality >= threshold if model else True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, (n, chars, symbols, lines, repeated)),
                     pa.array(quality, from_pandas=True), pa.array(failed), pa.array(kept)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
