"""Arrow helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step inside a task works on at once.
CHUNK_BYTES = 8 << 20


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of ``batch`` with about ``limit`` bytes of ``column`` each.

    A single longer text is a slice of its own; no text is cut.
    """
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: offsets (one more than texts) and all words.

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        offsets, words = before[offsets], words.filter(pa.array(full))
    return offsets, words


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in every [offsets[i], offsets[i+1])."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _factors(seed: int, base: int) -> tuple[np.ndarray, int]:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base


#: Fixed random factors of the bytes and odd bases of the two halves of a word's hash.
_HALVES = (_factors(21, 0x9E3779B97F4A7C15), _factors(22, 0xD6E8FEB86659FD93))


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of strings, as two arrays: each word's own polynomial in its bytes modulo 2**64."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for factors, base in _HALVES:
        steps = np.full(max(int(place.max(initial=0)) + 1, 1), base, dtype=np.uint64)
        steps[0] = 1
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(factors[data] * np.cumprod(steps)[place])))
        out.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return out[0], out[1]


class WordTable:
    """What ``compute`` gives for each distinct word, kept between batches of one worker.

    ``compute`` maps a list of words to a tuple of arrays with one row per
    word. The first words stay, which are the frequent ones, up to ``limit``
    bytes; what comes later is computed for its batch alone. That changes
    the time but no result. Words are known by a 128-bit hash, in sorted
    arrays, so a word costs its values and 16 bytes.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, ...]], limit: int = 64 << 20):
        self.compute, self.limit = compute, limit
        self.keys = self.checks = np.zeros(0, dtype=np.uint64)
        self.table: tuple[np.ndarray, ...] = ()

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Row number of every word, and the arrays these numbers point into."""
        encoded = words.dictionary_encode()
        key, check = word_hashes(encoded.dictionary)
        rows = np.searchsorted(self.keys, key)
        at = np.minimum(rows, max(len(self.keys) - 1, 0))
        known = (self.keys[at] == key) & (self.checks[at] == check) if len(self.keys) else np.zeros(len(key), dtype=bool)
        missing = np.flatnonzero(~known)
        table = self.table
        if len(missing):
            made = self.compute(encoded.dictionary.take(pa.array(missing)).to_pylist())
            if table and self.full():
                # rows of this batch alone, behind the kept ones
                rows[missing] = len(self.keys) + np.arange(len(missing))
                table = tuple(np.concatenate(x) for x in zip(table, made, strict=True))
            else:
                order = np.argsort(key[missing])
                new = missing[order]
                place = rows[new]
                self.keys, self.checks = np.insert(self.keys, place, key[new]), np.insert(self.checks, place, check[new])
                self.table = table = tuple(np.insert(old, place, own[order], axis=0) for old, own in zip(table, made, strict=True)) \
                    if table else tuple(x[order] for x in made)
                rows[known] += np.searchsorted(key[new], key[known])
                rows[new] = place + np.arange(len(new))
        return rows[encoded.indices.to_numpy()], table

    def full(self) -> bool:
        return sum(x.nbytes for x in (self.keys, self.checks, *self.table)) >= self.limit


_TABLES: dict[str, WordTable] = {}


def release_worker_tables() -> None:
    """Give back the memory of this worker's tables: an operator without one starts with this."""
    _TABLES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def worker_table(key: str, make: Callable[[], WordTable]) -> WordTable:
    """The table of model ``key`` in this worker, made once; tables of earlier models go, with their memory."""
    if key not in _TABLES:
        release_worker_tables()
        _TABLES[key] = make()
    return _TABLES[key]
