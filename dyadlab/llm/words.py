"""Vectorised word handling for Arrow batches: word bounds, 64-bit word hashes, shingles. NumPy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are worked on in pieces of about this many bytes; a longer text is a piece of its own
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True  # words are [^\x20\x09-\x0D]+
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[48:58] = MARKS[97:123] = False  # words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """Words of a few texts. ``first[i]:first[i + 1]`` are the words of text i; ``start``, ``end`` are byte places in ``data``."""

    def __init__(self, texts: list[bytes | None], separators: np.ndarray, lower: bool = True):
        joined = b" ".join([t or b"" for t in texts]) + b" "
        data = np.frombuffer(joined, np.uint8)
        self.data = _LOWER[data] if lower else data
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~separators[self.data]
        if len(texts) > 1:
            inside[self.text_start[1:] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, finalised together with its length."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, inverse = _upto(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], dtype=np.uint64)])
            return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle; no words, none."""
    h, out = words.hashes(), []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width if len(rolled) else 0):  # all texts of a piece together can have fewer words
            rolled += mix(h[k : len(h) - width + 1 + k], k + 1)
        rolled = mix(rolled, width)
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= width:
                s = np.sort(rolled[a : b - width + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                short = np.uint64(b - a)
                for k in range(b - a):
                    short += mix(h[a + k : a + k + 1], k + 1)[0]
                out.append(mix(np.array([short], np.uint64), 99))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def pieces(batches: Iterator[pa.RecordBatch], key: int = 0, text: int = 1) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """Ids and UTF-8 texts of a batch stream, some CHUNK_BYTES at a time. Rows without an id are left out."""
    for batch in batches:
        ids, texts = batch.column(key), batch.column(text)
        if ids.null_count:
            keep = ids.is_valid()
            ids, texts = ids.filter(keep), texts.filter(keep)
        ids, texts = ids.to_numpy(zero_copy_only=False).astype(np.int64), texts.cast(pa.binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"") + 1
            if size >= CHUNK_BYTES:
                yield ids[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield ids[start:], texts[start:]


def row_pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch stream, some CHUNK_BYTES of text each, with their UTF-8 texts. All rows are there, whatever their ids."""
    for batch in batches:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"") + 1
            if size >= CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
