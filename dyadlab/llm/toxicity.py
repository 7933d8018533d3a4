"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.llm.words import SPACES, Words, pieces, row_pieces

TRAIN_ROWS = 8_000  # labelled rows used for fitting at most, the smallest by hash of the key
DICTIONARY_BYTES = 4096
WINDOW_WORDS = 1  # words per window; measured best on held-out rows among 1, 2, 4, 8 and 12
GRAM = 5  # bytes per gram of the contrast
SLOTS = 1 << 20
LEVEL = 3
THRESHOLD = 0.7
# Both dictionaries end with this text and every window stands between pieces of it, so that zstandard never falls back
# to storing a short window raw and matches next to its end are seen; lengths then differ by the window's words alone.
PRIMER = bytes(0x80 | (i * 37 + i * i * 11) % 64 for i in range(96))
_HEAD, _TAIL = PRIMER + b" ", b" " + PRIMER[:16]


def held_out(key: int) -> bool:
    return zlib.crc32(str(key).encode()) % 3 == 1


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    if len(data) < width:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(data) - width + 1, np.uint64)
        for i in range(width):
            h = h * np.uint64(257) + data[i : len(data) - width + 1 + i]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _compressor(segments: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=18)
    made = zstandard.ZstdCompressionDict(segments + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float, float]  # of 1, the largest gain, log(1 + sum of gains)
    cut: float  # the logit that becomes the decision threshold

    def score(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        logit = self.weights[0] + self.weights[1] * largest + self.weights[2] * np.log1p(total) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Scorer:
    """Window gains: bytes that the toxic dictionary saves over the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = _compressor(ordinary), _compressor(toxic)
        self.known = np.zeros(SLOTS, bool)
        for text in (toxic, ordinary):
            self.known[_grams(np.frombuffer(text, np.uint8).astype(np.uint64), 4)] = True
        self.memory: dict[bytes, int] = {}

    def gain(self, window: bytes) -> int:
        g = self.memory.get(window)
        if g is None:
            framed = _HEAD + window + _TAIL
            g = len(self.pair[0].compress(framed)) - len(self.pair[1].compress(framed))
            if len(self.memory) >= 1 << 16:
                self.memory.clear()
            self.memory[window] = g
        return g

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The largest gain of any window of each text, and the sum of its positive gains. Every window counts; one that
        shares no four bytes with either dictionary compresses alike under both, and its gain is 0 without trying."""
        words = Words(texts, SPACES)
        data, largest, total = words.data, np.zeros(len(texts)), np.zeros(len(texts))
        if not len(words.start):
            return largest, total
        counts = np.diff(words.first)
        doc = np.repeat(np.arange(len(texts)), counts)
        begins = np.flatnonzero((np.arange(len(doc)) - words.first[doc]) % WINDOW_WORDS == 0)
        ends = np.minimum(begins + WINDOW_WORDS, words.first[doc[begins] + 1]) - 1
        start, end = words.start[begins], words.end[ends]
        # a blank stands before and after each window in its frame, as it does in the joined texts
        grams = np.concatenate([self.known[_grams(np.concatenate([[32], data, [32]]).astype(np.uint64), 4)], np.zeros(4, bool)])
        seen = np.concatenate([[0], np.cumsum(grams)])
        hit = np.flatnonzero(seen[np.maximum(end - 1, start + 1)] > seen[start])
        for w in hit.tolist():
            g = self.gain(data[start[w] : end[w]].tobytes())
            if g > 0:
                d = doc[begins[w]]
                largest[d] = max(largest[d], g)
                total[d] += g
        return largest, total


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _segments(words: dict[bytes, int], contrast: np.ndarray, floor: float) -> bytes:
    """Words with a gram of at least ``floor`` contrast, the strongest last (nearest), up to DICTIONARY_BYTES."""
    scored = []
    for w, n in words.items():
        if n >= 2:
            g = _grams(np.frombuffer(b" " + w + b" ", np.uint8).astype(np.uint64), GRAM)
            if len(g) and (top := contrast[g].max()) >= floor:
                scored.append((top, w))
    kept, size = [], 0
    for _, w in sorted(scored, reverse=True):
        if size + len(w) + 1 > DICTIONARY_BYTES:
            break
        kept.append(b" " + w)
        size += len(w) + 1
    return b"".join(reversed(kept))


def fit(rows: list[tuple[bytes | None, int]]) -> Model:
    """Dictionaries and calibration from (text, label) rows.

    Each class's dictionary is made of its words that hold byte grams far more frequent (by documents) in that class.
    How far is calibrated: of a few contrast floors, the one whose windows best separate the training rows. With one
    class only, every score is the same.
    """
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        prior = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
        return Model(b"", b"", (prior, 0.0, 0.0), math.log(THRESHOLD / (1 - THRESHOLD)))
    frequency, words = np.zeros((2, SLOTS)), ({}, {})
    for text, label in rows:
        parsed = Words([text], SPACES)
        plain = [parsed.data[a:b].tobytes() for a, b in zip(parsed.start, parsed.end)]
        for w in plain:
            words[label][w] = words[label].get(w, 0) + 1
        frequency[label, np.unique(_grams(np.frombuffer(b" " + b" ".join(plain) + b" ", np.uint8).astype(np.uint64), GRAM))] += 1
    part = (frequency + 0.5) / (np.array([[len(y) - y.sum()], [y.sum()]]) + 1)
    contrast = (np.sqrt(part[1]) - np.sqrt(part[0])) * np.abs(np.log(part[1] / part[0]))
    best: tuple[float, Model] | None = None
    for floor in (1.0, 1.5, 2.0, 2.5):
        toxic, ordinary = _segments(words[1], contrast, floor), _segments(words[0], -contrast, floor)
        scorer, x = Scorer(toxic, ordinary), np.ones((len(y), 3))
        for i in range(0, len(rows), 256):
            largest, total = scorer.features([t for t, _ in rows[i : i + 256]])
            x[i : i + 256, 1], x[i : i + 256, 2] = largest, np.log1p(total)
        w = _fit_logistic(x, y)
        p = x @ w
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        f1[:-1][p[order][:-1] == p[order][1:]] = -1  # ties stay together
        k = int(f1.argmax())
        cut = (p[order[k]] + (p[order[k + 1]] if k + 1 < len(y) else p[order[k]] - 1)) / 2
        loss = -float(np.mean(y * -np.logaddexp(0, -p) + (1 - y) * -np.logaddexp(0, p)))
        if best is None or loss < best[0]:
            best = loss, Model(toxic, ordinary, tuple(w), float(cut))
    return best[1]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out (CRC-32 of the key modulo 3 is 1)."""
    mine = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    mine = mine.filter(F.pmod(F.crc32(F.encode(F.col("key").cast("string"), "UTF-8")), F.lit(3)) != 1).orderBy(F.xxhash64("key"), "key").limit(rows)
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(mine), "key")  # at most ``rows`` short lines
    return fit([(None if r.text is None else r.text.encode(), r.label) for r in joined.orderBy("key", "label", "text").toLocalIterator()])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone, in one pass without a shuffle.

    Empty and null texts get the score of a text without any gain. Rows with a null key are left out; repeated rows are
    scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.toxic, model.ordinary)
        for keys, texts in pieces(batches):
            s = model.score(*scorer.features(texts))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([held_out(int(k)) for k in keys], pa.bool_()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that :func:`score` predicts 0 for; rows with null or repeated ids are judged like any
    other. One scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.toxic, model.ordinary)
        for rows, texts in row_pieces(batches, at):
            yield rows.filter(pa.array(model.score(*scorer.features(texts)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
