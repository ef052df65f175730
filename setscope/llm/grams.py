"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import zlib

import numpy as np

_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                   0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A uint64 hash of the given integer columns, row by row."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for part, factor in zip(parts, _FACTORS, strict=False):
        out = (out ^ part.astype(np.uint64)) * factor
        out ^= out >> np.uint64(29)
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    """A 32-bit hash of every word."""
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))


def char_grams(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of every word, sorted by word.

    A mark before and after each word takes part in the n-grams as a
    character; n-grams of marks alone or across words do not exist.
    """
    text = np.frombuffer(("\x00" + "\x00".join(words) + "\x00").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    mark = np.zeros(len(text), dtype=bool)
    mark[np.concatenate(([0], np.cumsum(lengths + 1)))] = True
    word = np.cumsum(mark) - 1
    of, bucket = [], []
    for n in sizes:
        if len(text) < n:
            continue
        at = np.arange(len(text) - n + 1)
        inner = np.concatenate(([0], np.cumsum(mark)))
        whole = (inner[at + n - 1] - inner[at + 1] == 0) if n > 1 else ~mark
        if n == 2:
            whole &= ~(mark[at] & mark[at + 1])
        at = at[whole]
        of.append(word[at])
        parts = [text[at + i] for i in range(n)]
        bucket.append((mixed(*parts) ^ np.uint64(n)) % np.uint64(buckets))
    of, bucket = np.concatenate(of), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return of[order], bucket[order]
