"""Toxicity scores: a bidirectional GRU with attention over character and word inputs, on overlapping windows.

The input of a word joins, for the word and for its character n-grams, a
learned embedding and a statistic: the smoothed log odds of toxic documents
among the labelled ones that hold it. In training a document's own label is
taken out of the statistics of its words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from setscope.llm import gru, logistic
from setscope.llm.folds import held_out, labelled_texts
from setscope.llm.grams import char_grams, word_hashes
from setscope.llm.text import WordTable, chunks, split_words, worker_table
from setscope.session import materialize

#: Labelled documents of each label that the model learns from, at most.
PER_CLASS = 1500
SIZE, STRIDE = 32, 16
CHAR_SIZES = (3, 4, 5)
BUCKETS = 1 << 17
EMBEDDED, EMBEDDING = 1 << 13, 4
SHRINK = 4.0
INPUTS = 3 + 2 * EMBEDDING
ROUNDS, BATCH = 300, 256
STRONG = 0.999
DECAY = 0.01
#: Clean windows of a document to learn from: those with the highest statistics, and some at hashed places.
HARD, EASY = 2, 2
BLOCK = 2048
THRESHOLD = 0.7


def _plain(words: list[str]) -> list[str]:
    return ["".join(filter(str.isalnum, w.lower())) for w in words]


def _odds(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log odds of toxic documents, shrunk to and measured from their overall share."""
    rate = (toxic + SHRINK * share) / (toxic + clean + SHRINK)
    return np.log(rate / (1 - rate)) - np.log(share / (1 - share))


class Inputs:
    """Word inputs of a model; ``own`` is the label of the documents that the words come from, when learning."""

    def __init__(self, model: dict, own: int | None = None):
        self.model = model
        less = [np.maximum(n - (own == label), 0) for label, n in zip((1, 0), model["counts"], strict=True)]
        self.stats = _odds(*less, model["share"])

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Statistics (words x 3), embedding row of each word, and of each n-gram with its word."""
        plain = _plain(words)
        word = (word_hashes(plain) % np.uint64(BUCKETS)).astype(np.int64)
        of, gram = char_grams(plain, CHAR_SIZES, BUCKETS)
        odds = self.stats[1][gram]
        number = np.bincount(of, minlength=len(words))
        top = np.zeros(len(words))
        begins = np.flatnonzero(np.concatenate(([True], np.diff(of) != 0))) if len(of) else np.zeros(0, np.int64)
        if len(of):
            top[of[begins]] = np.maximum.reduceat(odds, begins)
        mean = np.bincount(of, weights=odds, minlength=len(words)) / np.maximum(number, 1)
        own = np.where(number > 0, self.stats[0][word], 0)
        return np.column_stack((own, top, mean)), word % EMBEDDED, of, gram % EMBEDDED

    def vectors(self, words: list[str]) -> np.ndarray:
        stats, word, of, gram = self.parts(words)
        return np.hstack((stats, self.model["words"][word], _gram_means(self.model["grams"], of, gram, len(words))))


def _gram_means(table: np.ndarray, of: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    number = np.maximum(np.bincount(of, minlength=n), 1)
    return np.column_stack([np.bincount(of, weights=table[gram, k], minlength=n) for k in range(table.shape[1])]) / number[:, None]


def window_starts(n: int) -> np.ndarray:
    """First words of the overlapping windows that cover a text of n > 0 words."""
    return STRIDE * np.arange(max(0, -(-(n - SIZE) // STRIDE)) + 1)


def _count_documents(rows: DataFrame) -> np.ndarray:
    """Toxic and clean documents that hold a word or n-gram: (label 1 and 0, word and n-gram, bucket)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                offsets, words = split_words(part.column("text"))
                words = words.to_pylist()
                for a, b, label in zip(offsets[:-1], offsets[1:], part.column("label").to_pylist(), strict=True):
                    own = sorted(set(_plain(words[a:b])) - {""})
                    if own:
                        word = np.unique(word_hashes(own) % np.uint64(BUCKETS)).astype(np.int64)
                        total[1 - label, 0, word] += 1
                        total[1 - label, 1, np.unique(char_grams(own, CHAR_SIZES, BUCKETS)[1])] += 1
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)[place])], names=["place", "n"])

    table = rows.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(4 * BUCKETS)
    counts[table["place"].to_numpy()] = table["n"].to_numpy()
    return counts.reshape(2, 2, BUCKETS)


def _pick_windows(rows: DataFrame, model: dict) -> list[tuple[int, list[str]]]:
    """(label, words) of the windows to learn from: the strongest one of a toxic document, some of a clean one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = {label: Inputs(model, label) for label in (0, 1)}
        for batch in batches:
            for part in chunks(batch, "text"):
                offsets, words = split_words(part.column("text"))
                words = words.to_pylist()
                ids, labels, out = [], [], []
                for a, b, label, doc_id in zip(offsets[:-1], offsets[1:], part.column("label").to_pylist(),
                                               part.column("doc_id").to_pylist(), strict=True):
                    if a == b:
                        continue
                    own = words[a:b]
                    strength = inputs[label].parts(own)[0][:, :2].sum(axis=1)
                    starts = window_starts(b - a)
                    order = np.argsort([-strength[s:s + SIZE].max() for s in starts], kind="stable")
                    picked = set(order[:1 if label else HARD].tolist())
                    if not label:
                        picked |= {zlib.crc32(f"{doc_id}:{k}".encode()) % len(starts) for k in range(EASY)}
                    for p in sorted(picked):
                        ids.append(doc_id)
                        labels.append(label)
                        out.append(own[starts[p]:starts[p] + SIZE])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()),
                                                  pa.array(out, pa.list_(pa.string()))], names=["doc_id", "label", "words"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(
        run, "doc_id long, label int, words array<string>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["label"], r["doc_id"], r["words"]))
    return [(r["label"], r["words"]) for r in found]


def _train(windows: list[tuple[int, list[str]]], model: dict) -> dict:
    """Fit embeddings and network on batches that are half toxic.

    Half of a batch's toxic windows are made: strong words of a toxic window,
    at any places of a clean one, so that few labels show many contexts.
    Strong are words above nearly all words of clean windows.
    """
    rnd = np.random.default_rng(7)
    places = {label: {} for label in (0, 1)}
    for label, words in windows:
        for w in words:
            places[label].setdefault(w, len(places[label]))
    parts = {label: Inputs(model, label).parts(list(p)) for label, p in places.items()}
    base = len(places[0])
    stats = np.vstack((parts[0][0], parts[1][0]))
    word = np.concatenate((parts[0][1], parts[1][1]))
    of, gram = np.concatenate((parts[0][2], base + parts[1][2])), np.concatenate((parts[0][3], parts[1][3]))
    number = np.maximum(np.bincount(of, minlength=len(stats)), 1)
    index = np.zeros((SIZE, len(windows)), dtype=np.int64)
    mask = np.zeros((SIZE, len(windows)), dtype=bool)
    for i, (label, words) in enumerate(windows):
        index[:len(words), i] = [places[label][w] + label * base for w in words]
        mask[:len(words), i] = True
    y = np.array([label for label, _ in windows], dtype=float)
    params = gru.initial(INPUTS) | {"words": model["words"], "grams": model["grams"]}
    adam = gru.Adam(params)
    by_label = [np.flatnonzero(y == v) for v in (0, 1)]
    strength = stats[:, :2].sum(axis=1)
    clean = index[:, by_label[0]]
    limit = np.quantile(strength[clean[mask[:, by_label[0]]]], STRONG)
    strong = {w: np.unique(own) for w in by_label[1] for own in [index[mask[:, w], w]]
              for own in [own[strength[own] > limit]] if len(own)}
    shown = np.array(list(strong) or by_label[1])
    for _ in range(ROUNDS):
        some = np.concatenate((rnd.choice(by_label[0], BATCH // 2), rnd.choice(shown, BATCH // 2)))
        places_, live = index[:, some], mask[:, some]
        for j in range(BATCH // 2, BATCH * 3 // 4 if strong else 0):
            host = rnd.choice(by_label[0])
            places_[:, j], live[:, j] = index[:, host], mask[:, host]
            words_ = rnd.permutation(strong[some[j]])[:rnd.integers(1, 4)]
            n = int(live[:, j].sum())
            places_[rnd.permutation(n)[:len(words_)], j] = words_[:n]
        vectors = np.hstack((stats, params["words"][word], _gram_means(params["grams"], of, gram, len(stats))))
        x = vectors[places_]
        logits, kept = gru.forward(params, x @ params["w"] + params["c"], live, keep=True)
        grads, d_projected = gru.backward(params, kept, live, (logistic.sigmoid(logits) - y[some]) / len(some))
        grads["w"] = np.einsum("twi,twp->ip", x, d_projected)
        grads["c"] = d_projected.sum(axis=(0, 1))
        d_vector = np.zeros_like(vectors)
        np.add.at(d_vector, places_.reshape(-1), (d_projected @ params["w"].T).reshape(-1, INPUTS))
        grads["words"], grads["grams"] = np.zeros_like(params["words"]), np.zeros_like(params["grams"])
        np.add.at(grads["words"], word, d_vector[:, 3:3 + EMBEDDING])
        np.add.at(grads["grams"], gram, (d_vector[:, 3 + EMBEDDING:] / number[:, None])[of])
        adam.step(grads)
        for table in ("words", "grams"):
            params[table] *= 1 - DECAY
    return model | params


def _projections(model: dict, own: int | None = None) -> WordTable:
    inputs = Inputs(model, own)

    def compute(words: list[str]) -> tuple[np.ndarray, ...]:
        return ((inputs.vectors(words) @ model["w"] + model["c"]).astype(np.float32),)

    return WordTable(compute)


def text_logits(offsets: np.ndarray, words: pa.Array, model: dict, table: WordTable) -> np.ndarray:
    """Highest window logit of every text; -inf for a text without words."""
    out = np.full(len(offsets) - 1, -np.inf)
    if not len(words):
        return out
    net = {k: model[k].astype(np.float32) for k in ("uf", "ub", "a", "v", "o", "d")}
    rows, (projected,) = table.lookup(words)
    n = np.diff(offsets)
    number = np.where(n > 0, np.maximum(0, -(-(n - SIZE) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), number)
    start = STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
    length = np.minimum(n[text] - start, SIZE)
    first = offsets[:-1][text] + start
    logits = np.empty(len(text))
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), BLOCK):
        some = order[at:at + BLOCK]
        size = int(length[some].max())
        place = np.arange(size)[:, None]
        live = place < length[some]
        logits[some] = gru.forward(net, projected[rows[np.where(live, first[some] + place, first[some])]], live)
    out[n > 0] = np.maximum.reduceat(logits, np.flatnonzero(start == 0))
    return out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Model fitted on labels.toxic of the learning folds; None without documents of both labels.

    The sample is bounded by ``per_class``; of it, counts by bucket, windows of
    ``SIZE`` words and one logit a document come to the driver. Calibrated on
    the sample's documents, weighed as all labels of the learning folds.
    """
    picked, counts = labelled_texts(docs, labels, "toxic", per_class, learn_only=True, seed="toxic")
    rows = materialize(picked.select("doc_id", F.col("label").cast("int").alias("label"), "text"), "toxic")
    sampled = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sampled) < 2:
        return None
    rnd = np.random.default_rng(3)
    model = {"key": uuid.uuid4().hex, "counts": _count_documents(rows), "share": sampled[1] / sum(sampled.values()),
             "words": rnd.normal(0, 0.1, (EMBEDDED, EMBEDDING)), "grams": rnd.normal(0, 0.1, (EMBEDDED, EMBEDDING))}
    windows = _pick_windows(rows, model)
    if len({label for label, _ in windows}) < 2:
        return None
    model = _train(windows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {label: _projections(model, label) for label in (0, 1)}
        for batch in batches:
            for part in chunks(batch, "text"):
                label = part.column("label").to_numpy()
                for v, table in tables.items():
                    own = part.filter(pa.array(label == v))
                    z = text_logits(*split_words(own.column("text")), model, table)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("label"), pa.array(z)],
                                                     names=["doc_id", "label", "z"])

    scored = rows.mapInArrow(run, StructType([rows.schema["doc_id"], *StructType.fromDDL("label int, z double").fields]))
    found = scored.where(F.col("z") > float("-inf")).toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending")])
    y = found["label"].to_numpy().astype(float)
    weight = np.where(y == 1, counts[1] / sampled[1], counts[0] / sampled[0])
    scale, shift = logistic.calibrate(found["z"].to_numpy(), y, weight)
    return model | {"scale": scale, "shift": shift}


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; the text is the only input.

    A text's score is the calibrated probability of label 1 given its most
    toxic window. A null text or one without words scores 0, and so does
    every text where there is no model. Repeated rows and null ids are scored
    like any other, further columns are not read, and an empty table gives
    an empty result.
    """
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    schema = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())])

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = worker_table(f"toxic {own['key']}", lambda: _projections(own)) if own else None
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                offsets, words = split_words(part.column("text"))
                p = np.zeros(part.num_rows)
                if own:
                    z = text_logits(offsets, words, own, table)
                    p = np.where(np.isfinite(z), logistic.sigmoid(own["scale"] * np.maximum(z, -60) + own["shift"]), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p),
                     pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)
