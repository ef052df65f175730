"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from setscope.llm.folds import held_out, learnable
from setscope.llm.text import WordTable, chunks, split_words, sums, worker_table

VOCABULARY = "piece_bpe_32k.model"
#: Documents of each language that the piece counts are learned from (expected number; all, if fewer).
SAMPLE_DOCS = 3000
SMOOTHING = 0.1
UNKNOWN = 1e-7
UNDETERMINED = "und"
#: Positions of words whose segmentations are summed at once.
POSITIONS = 100_000
#: Bytes of text worked on at once: a word has a probability for every language.
CHUNK = 4 << 20


def runs(word: str) -> list[str]:
    """Runs of letters of a word, compatibility-normalised and in lower case."""
    low = unicodedata.normalize("NFKC", word).lower()
    return "".join(c if c.isalpha() else " " for c in low).split()


def _vocabulary(name: str) -> list[str]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def _segmenter(name: str) -> WordTable:
    """Word table of hard segmentations, for counting: one array of piece ids per word."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))

    def compute(words: list[str]) -> tuple[np.ndarray, ...]:
        found = np.empty(len(words), dtype=object)
        for i, word in enumerate(words):
            found[i] = np.array([p for piece in model.encode(runs(word), num_threads=1) for p in piece], dtype=np.int64)
        return (found,)

    return WordTable(compute, limit=4 << 20)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: str = VOCABULARY,
          smoothing: float = SMOOTHING) -> dict:
    """Model: language values (sorted), log share of each, piece probabilities (pieces x languages).

    Learns from documents of the learning folds with a text and a language.
    Of a language with more than ``sample_docs`` documents a hash sample of
    about that many is read; piece counts are summed in Spark. Counts by
    language, and by language and piece, come to the driver; texts are
    filtered where they are read and never shuffled.
    """
    own = docs.select("doc_id", "text", "lang").where(
        learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    limit = F.create_map(*[F.lit(x) for lang in langs for x in (lang, (sample_docs << 30) // shares[lang])]) \
        if langs else F.create_map().cast("map<string,bigint>")
    picked = own.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < limit[F.col("lang")])

    size = len(_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(f"segments {vocabulary}", lambda: _segmenter(vocabulary))
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                offsets, words = split_words(part.column("text"))
                if not len(words):
                    continue
                rows, (pieces,) = table.lookup(words)
                lang_of = part.column("lang").dictionary_encode()
                code = np.repeat(lang_of.indices.to_numpy(), np.diff(offsets))
                for k, lang in enumerate(lang_of.dictionary.to_pylist()):
                    times = np.bincount(rows[code == k], minlength=len(pieces))
                    used = [w for w in np.flatnonzero(times) if len(pieces[w])]
                    if used:
                        flat = np.concatenate([pieces[w] for w in used])
                        n = np.repeat(times[used], [len(pieces[w]) for w in used])
                        own = seen.setdefault(lang, np.zeros(size, dtype=np.int64))
                        own += np.bincount(flat, weights=n, minlength=size).astype(np.int64)
        for lang, own in seen.items():
            piece = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(piece), pa.string()), pa.array(piece.astype(np.int32)),
                                              pa.array(own[piece])], names=["lang", "piece", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, piece int, n long").groupBy(
        "lang", "piece").agg(F.sum("n").alias("n")).collect()
    table = np.full((size, len(langs)), smoothing)
    column = {lang: i for i, lang in enumerate(langs)}
    for r in counted:
        table[r["piece"], column[r["lang"]]] += r["n"]
    share = np.array([shares[x] for x in langs], dtype=float)
    return {"key": uuid.uuid4().hex, "langs": langs, "vocabulary": vocabulary, "prior": np.log(share / share.sum()),
            "table": table / table.sum(axis=0, keepdims=True)}


class Scorer:
    """Log probability of words under every language, by the forward algorithm over all segmentations."""

    def __init__(self, model: dict):
        vocabulary = _vocabulary(model["vocabulary"])
        self.ids = {p: i for i, p in enumerate(vocabulary)}
        #: every beginning of a piece, with the piece's id or -1
        self.begins = {p[:k]: -1 for p in vocabulary for k in range(1, len(p))} | self.ids
        self.longest = max(map(len, vocabulary))
        langs = len(model["langs"])
        self.none, self.unknown = len(vocabulary), len(vocabulary) + 1
        self.table = np.vstack((model["table"], np.zeros((1, langs)), np.full((1, langs), UNKNOWN)))

    def log_probs(self, texts: list[str]) -> np.ndarray:
        """One row per text and a column per language; a character outside the vocabulary is a piece of its own."""
        out = np.zeros((len(texts), self.table.shape[1]))
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(texts[order[end]]) <= POSITIONS:
                end += 1
            some = order[at:end]
            out[some] = self._forward([texts[i] for i in some])
            at = end
        return out

    def _forward(self, texts: list[str]) -> np.ndarray:
        """Texts in order of length. Probabilities of prefixes are kept relative to the last one."""
        n, length, get = len(texts), len(texts[-1]), self.begins.get
        width = min(self.longest, length)
        ids = np.full((length, width, n), self.none, dtype=np.int32)
        ids[:, 0] = self.unknown
        place, found = [], []
        for t, text in enumerate(texts):
            for begin in range(len(text)):
                for end in range(begin + 1, min(begin + width, len(text)) + 1):
                    piece = get(text[begin:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        place.append(((end - 1) * width + end - begin - 1) * n + t)
                        found.append(piece)
        ids.reshape(-1)[place] = found
        used = (ids != self.none).any(axis=2)
        lengths = np.array([len(x) for x in texts])
        total = np.zeros((n, self.table.shape[1]))
        before = [np.ones_like(total)]
        for end in range(length):
            now = np.zeros_like(total)
            for size, prefix in enumerate(reversed(before)):
                if used[end, size]:
                    now += prefix * self.table[ids[end, size]]
            total += np.where((end < lengths)[:, None], np.log(now), 0)
            before = [x / now for x in before[len(before) == width:]] + [np.ones_like(total)]
        return total


def _word_scores(model: dict) -> WordTable:
    scorer = Scorer(model)
    # many words share a run: "The", "the," and "the"
    by_run = WordTable(lambda own: (scorer.log_probs(["▁" + r for r in own]),))

    def compute(words: list[str]) -> tuple[np.ndarray, ...]:
        parts = [runs(w) for w in words]
        of = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        out = np.zeros((len(words), scorer.table.shape[1]))
        if len(of):
            rows, (logs,) = by_run.lookup(pa.array([r for p in parts for r in p]))
            np.add.at(out, of, logs[rows])
        return out, np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))

    return WordTable(compute)


def score_texts(texts: pa.Array, model: dict, table: WordTable) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for every text."""
    offsets, words = split_words(texts)
    langs = np.array([*model["langs"], UNDETERMINED], dtype=object)
    best, score = np.full(len(texts), len(langs) - 1), np.zeros(len(texts))
    if len(words) and model["langs"]:
        rows, (logs, letter) = table.lookup(words)
        total = sums(logs[rows], offsets) + model["prior"]
        known = sums(letter[rows].astype(np.int64), offsets) > 0
        top = total.max(axis=1, keepdims=True)
        posterior = 1 / np.exp(total - top).sum(axis=1)
        best[known], score[known] = total.argmax(axis=1)[known], posterior[known]
    return langs[best].tolist(), score


def identify(docs: DataFrame, model: dict | None = None, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` as doc (its other columns), held_out, lang_pred, score and, if asked for, text.

    A null text, a text without a letter, or a model without languages gives
    ``und`` with score 0. Only the text is an input. Rows that repeat or have
    no id are scored like any other; an empty table gives an empty result.
    """
    model = learn(docs) if model is None else model
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc"),
                       held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    schema = StructType([rows.schema["doc"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), *([StructField("text", StringType())] if keep_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(f"lang {model['key']}", lambda: _word_scores(model))
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                lang, score = score_texts(part.column("text"), model, table)
                text = [part.column("text")] if keep_text else []
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("held_out"), pa.array(lang, pa.string()),
                                                  pa.array(score), *text], names=schema.names)

    return rows.mapInArrow(run, schema)
