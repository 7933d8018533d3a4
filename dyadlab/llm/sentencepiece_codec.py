"""SentencePiece encoding and decoding in batches with NumPy: equal-length words advance together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.llm.words import mix, row_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
CACHE_WORDS = 1 << 19
_MULTIPLIER = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        a = np.full(n, base, np.uint64)
        a[:1] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hash_row(points: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial, for substring hashes by subtraction; one more column than ``points``."""
    with np.errstate(over="ignore"):
        terms = (points.astype(np.uint64) + np.uint64(1)) * _powers(points.shape[-1])[0]
        zero = np.zeros((*points.shape[:-1], 1), np.uint64)
        return np.concatenate([zero, np.cumsum(terms, axis=-1, dtype=np.uint64)], axis=-1)


class Codec:
    """Pieces of a model as sorted keys with ids and scores.

    ``kind`` "unigram" segments by Viterbi: the best score of each prefix is a vectorised maximum over the pieces that
    end there, whose length is the backpointer. ``kind`` "bpe" needs the merge order instead, since the sum of its scores
    is not what the model maximises: in each round every word of a batch merges its best pair, leftmost among equals.
    """

    def __init__(self, names: list[str], scores: list[float], kind: str = "bpe", special: set[int] = frozenset(), byte_ids: list[int] | None = None, unknown: int = 0):
        self.kind, self.byte_ids, self.unknown = kind, byte_ids, unknown
        usable = [i for i in range(len(names)) if i not in special and names[i]]
        keys = np.array([self._key(names[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        self.scores = np.array([scores[i] for i in usable], np.float64)[order]
        self.longest = max((len(names[i]) for i in usable), default=1)
        self.crossing = any("▁" in names[i].lstrip("▁") for i in usable)
        raw = [b""] * len(names)
        for i in usable:
            raw[i] = names[i].replace("▁", " ").encode()
        for b, i in enumerate(byte_ids or []):
            raw[i] = bytes([b])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_size = np.array([len(r) for r in raw], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_size)])[:-1]
        self.memory: dict[int, np.ndarray] = {}

    @staticmethod
    def _key(name: str) -> int:
        points = _code_points(name)
        return int(mix(_hash_row(points)[-1:] + np.uint64(len(points)))[0])

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        by_name = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        bytes_ = [by_name[f"<0x{b:02X}>"] for b in range(256)] if by_name else None
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kind, special, bytes_, sp.unk_id())

    def _spans(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids (or -1) and scores (or -inf) of all substrings: [word, start, length - 1]."""
        n, size = words.shape
        prefix, inverse = _hash_row(words), _powers(size)[1]
        width = min(size, self.longest)
        ids, scores = np.full((n, size, width), -1, np.int32), np.full((n, size, width), -np.inf)
        with np.errstate(over="ignore"):
            for k in range(1, width + 1):
                h = mix((prefix[:, k:] - prefix[:, :-k]) * inverse[: size - k + 1] + np.uint64(k))
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                ids[:, : size - k + 1, k - 1] = np.where(hit, self.ids[at], -1)
                scores[:, : size - k + 1, k - 1] = np.where(hit, self.scores[at], -np.inf)
        return ids, scores

    def _merge(self, scores: np.ndarray) -> np.ndarray:
        """End of the symbol that begins at each place of each word (0 where none begins)."""
        n, size, width = scores.shape
        end = np.tile(np.arange(1, size + 1), (n, 1))
        row, start = np.arange(n)[:, None], np.arange(size)[None, :]
        live = np.arange(n)
        while len(live):
            e = end[live]
            after = np.where((e > 0) & (e < size), np.take_along_axis(e, np.minimum(e, size - 1), 1), 0)
            length = after - start
            ok = (after > 0) & (length <= width)
            gain = np.where(ok, scores[live[:, None], start, np.clip(length - 1, 0, width - 1)], -np.inf)
            best = gain.argmax(1)
            rows = row[: len(live), 0]
            able = gain[rows, best] > -np.inf
            live, best, rows = live[able], best[able], rows[able]
            middle = e[rows, best]
            end[live, best] = after[rows, best]
            end[live, middle] = 0
        return end

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        n, size, width = scores.shape
        penalty = (self.scores.min() if len(self.scores) else 0.0) - 10.0  # of a character that no piece covers
        best, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        best[:, 0] = 0
        for j in range(1, size + 1):
            reach = np.arange(1, min(j, width) + 1)
            options = best[:, j - reach] + scores[:, j - reach, reach - 1]
            options[:, 0] = np.where(np.isfinite(scores[:, j - 1, 0]), options[:, 0], best[:, j - 1] + penalty)
            back[:, j] = reach[options.argmax(1)]
            best[:, j] = options.max(1)
        end, at, rows = np.zeros((n, size), np.int64), np.full(n, size), np.arange(n)
        while len(rows):
            begin = at[rows] - back[rows, at[rows]]
            end[rows, begin] = at[rows]
            at[rows] = begin
            rows = rows[begin > 0]
        return end

    def segment(self, words: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of code points (words of one length)."""
        ids, scores = self._spans(words)
        end = self._merge(scores) if self.kind == "bpe" else self._viterbi(scores)
        w, s = np.nonzero(end)
        got = ids[w, s, end[w, s] - s - 1]
        bounds = np.searchsorted(w, np.arange(len(words) + 1)).tolist()
        got = got.astype(np.int32)
        out = [got[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.unique(w[got < 0]).tolist():  # words with characters that no piece covers
            mine: list[int] = []
            for place, g in zip(s[bounds[i] : bounds[i + 1]].tolist(), out[i].tolist()):
                mine += [g] if g >= 0 else [self.byte_ids[b] for b in chr(words[i, place]).encode()] if self.byte_ids else [self.unknown]
            out[i] = np.array(mine, np.int32)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts. Spaces become the space mark, one more of which stands before each text that is
        not empty. Words begin at the first of a run of space marks; no piece may reach across such a place (checked)."""
        marked = [("▁" + t.replace(" ", "▁")) if t else "" for t in texts]
        points = _code_points("".join(marked))
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        if not len(points):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        blank = points == SPACE
        begins = blank & ~np.concatenate([[False], blank[:-1]]) if not self.crossing else np.zeros(len(points), bool)
        begins[text_at[:-1][sizes > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))
        prefix = _hash_row(points)
        with np.errstate(over="ignore"):
            h = mix((prefix[end] - prefix[start]) * _powers(len(points))[1][start] + (end - start).astype(np.uint64))
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.memory) > CACHE_WORDS:
            self.memory.clear()
        names = unique.tolist()
        new = np.array([i for i, x in enumerate(names) if x not in self.memory], np.int64)
        lengths = (end - start)[first[new]] if len(new) else np.zeros(0, np.int64)
        for size in np.unique(lengths):
            group = new[lengths == size]
            step = max(1, (1 << 18) // (int(size) * min(int(size), self.longest)))
            for a in range(0, len(group), step):
                some = group[a : a + step]
                matrix = points[start[first[some]][:, None] + np.arange(size)]
                for i, ids in zip(some.tolist(), self.segment(matrix)):
                    self.memory[names[i]] = ids
        found = [self.memory[x] for x in names]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat, at = np.concatenate(found), np.concatenate([[0], np.cumsum(count)])[:-1]
        per_word = count[inverse]
        done = np.concatenate([[0], np.cumsum(per_word)])
        out = flat[np.repeat(at[inverse] - done[:-1], per_word) + np.arange(done[-1])]
        return done[np.searchsorted(start, text_at)], out

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """UTF-8 of each sequence: the pieces' bytes, less the space that encoding put in front."""
        size = self.piece_size[ids]
        done = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_bytes[np.repeat(self.piece_start[ids] - done[:-1], size) + np.arange(done[-1])].tobytes()
        bounds = done[offsets].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def codec(path: str, kind: str) -> Codec:
    return Codec.load(path, kind)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding the ids gives the text back) of every row, without a shuffle.

    Whole texts are encoded. Null and empty texts have no ids and come back empty. A text that holds the space mark
    itself is decoded with a space in its place and so reports no round trip. Null and repeated ids keep their lines, ids their type.
    """
    kind_of_key = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, kind)
        for rows, texts in row_pieces(batches, 1):
            offsets, ids = c.encode([(t or b"").decode() for t in texts])
            back = c.decode(offsets, ids)
            same = [b == (t or b"") for b, t in zip(back, texts)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind_of_key}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give an empty text; ids outside the model fail; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, kind)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = c.decode(offsets, np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
