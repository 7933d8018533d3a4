"""Cross-tokenizer alignment: token-byte incidence matrices in CSR, links as row products, corpus-wide counts of id pairs."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.session import cut

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
SIDE = 1 << 24  # an id pair is a * SIDE + b
CACHE_CHUNKS, CACHE_CHARS = 1 << 18, 1 << 25  # distinct chunks, and characters in them, that a task remembers before it starts anew
BATCH_BYTES = 1 << 20
HOT_PAIRS = 1 << 16  # most frequent pairs whose counts are broadcast; of all others, each has at most a 1/HOT_PAIRS of all links
PAIRS_HELD = 1 << 21  # distinct pairs a task counts before it sends them on


# ---- sparse matrices


@dataclass
class Csr:
    start: np.ndarray  # one more than rows
    column: np.ndarray
    value: np.ndarray
    width: int

    def row_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    @classmethod
    def of_entries(cls, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, width: int) -> Csr:
        """From entries in any order; entries of one place are added up."""
        place, at = np.unique(row * width + column, return_inverse=True)
        r = place // max(width, 1)
        return cls(np.searchsorted(r, np.arange(rows + 1)), place % max(width, 1), np.bincount(at, value, len(place)).astype(np.int64), width)

    def transposed(self) -> Csr:
        order = np.argsort(self.column, kind="stable")
        return Csr(np.searchsorted(self.column[order], np.arange(self.width + 1)), self.row_of_entry()[order], self.value[order], len(self.start) - 1)


def row_products(a: Csr, b: Csr) -> Csr:
    """A B by Gustavson's rule: row i is the sum of the rows of B that the entries of row i of A name, weighted by these."""
    size = b.start[a.column + 1] - b.start[a.column]
    done = np.cumsum(size)
    entry = np.repeat(np.arange(len(a.column)), size)
    inner = b.start[a.column][entry] + np.arange(len(entry)) - (done - size)[entry]
    return Csr.of_entries(a.row_of_entry()[entry], b.column[inner], a.value[entry] * b.value[inner], len(a.start) - 1, b.width)


def token_bytes(sizes: np.ndarray) -> Csr:
    """Tokens laid end to end against the bytes they cover."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    return Csr(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))


@dataclass
class Alignment:
    """Two tilings of the same bytes. ``overlap``: tokens of A against tokens of B, shared bytes. ``group_a``, ``group_b``: tokens
    against the groups that the common ends cut."""

    end_a: np.ndarray
    end_b: np.ndarray
    common: np.ndarray
    overlap: Csr
    group_a: Csr
    group_b: Csr

    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """Overlap links whose tokens end at the same byte."""
        a, b = self.overlap.row_of_entry(), self.overlap.column
        same = self.end_a[a] == self.end_b[b]
        return a[same], b[same]

    def shared_groups(self) -> Csr:
        """Links of all tokens of A with all tokens of B in their group (the values are 1)."""
        return row_products(self.group_a, self.group_b.transposed())


def align_tokens(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Alignment:
    """Align two tokenizations of the same bytes, given the tokens' byte lengths (none of them 0)."""
    a, b = token_bytes(sizes_a), token_bytes(sizes_b)
    if a.width != b.width:
        raise ValueError("the tokenizations cover different numbers of bytes")
    end_a, end_b = a.start[1:], b.start[1:]
    common = np.intersect1d(end_a, end_b, assume_unique=True)

    def groups(end: np.ndarray) -> Csr:
        return Csr(np.arange(len(end) + 1), np.searchsorted(common, end), np.ones(len(end), np.int64), len(common))

    return Alignment(end_a, end_b, common, row_products(a, b.transposed()), groups(end_a), groups(end_b))


# ---- tokenizers


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the public pattern of byte-level vocabularies
COMMON_SCRIPTS = "\u0530"  # below it stand letters on whose classes all Unicode versions agree


class TokenizerPair:
    """A is read from its JSON file. Where ids are in merge order, as they are in this family, merging by rank is the same and a
    faster library does it; texts with rarer scripts go through the first library, whose character classes then decide."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        in_order = all(x < y for x, y in zip(merged, merged[1:])) and len(merged) + 256 == len(model["vocab"]) - len(set(self.a.get_added_tokens_decoder()) & set(model["vocab"].values()))
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        # ids as text, followed by what can stand after a token of a group
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = np.array([[f"{i}{mark}" for i in range(most)] for mark in (",", "|", ";", "")], object)

    def quick(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or max(text) < COMMON_SCRIPTS)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with a space (which B adds by itself)."""
        return self.fast.encode_ordinary(text) if self.quick(text) else self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)

    def covers(self, text: str, ids_a: list[int], ids_b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, ids_a)) == text.encode() == b"".join(map(self.bytes_b.__getitem__, ids_b))


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> TokenizerPair:
    return TokenizerPair(path_a, path_b)


# A cut stands before a space, not the last character, that follows a character which no tokenizer counts as white space. Both
# split there and neither looks back across it: A's words begin at such a space, and no piece of B holds a space mark after another
# character. So the tokens of a text are those of its chunks, every cut is a common end, and chunks may be joined in any order.
_BLANKS = "\\s\\x1c-\\x1f\\x85\\u180e\\u200b-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\ufeff"
_CUT = re.compile(f"(?<=[^{_BLANKS}])(?= .)", re.DOTALL)
_BLANK_END = re.compile(f"[{_BLANKS}]\\Z")
JOINED = 4096  # chunks that are tokenized as one text


class ChunkTable:
    """What the alignment of each distinct chunk comes to, filled as chunks are met."""

    def __init__(self, pair: TokenizerPair):
        self.pair = pair
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.numbers = np.zeros((4, 0), np.int64)  # fine, n_a, n_b, n_groups
        self.first, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _tokenized(self, chunks: list[str]) -> Iterator[tuple[list[str], list[int], list[int], bool]]:
        """Runs of chunks with the ids of both sides; a chunk that a side does not give back byte by byte stands alone, without ids."""
        runs, quick, slow = [], [], []
        for c in chunks:
            runs.append([c]) if _BLANK_END.search(c) else (quick if self.pair.quick(c) else slow).append(c)
        runs += [some[i : i + JOINED] for some in (quick, slow) for i in range(0, len(some), JOINED)]
        while runs:
            run = runs.pop()
            text = "".join(run)
            a, b = self.pair.encode(text)
            if self.pair.covers(text, a, b):
                yield run, a, b, True
            elif len(run) == 1:
                yield run, [], [], False
            else:
                runs += [run[: len(run) // 2], run[len(run) // 2 :]]

    def add(self, chunks: list[str]) -> None:
        done = list(self._tokenized(chunks))
        flat_a, flat_b = (np.array(list(itertools.chain.from_iterable(x[k] for x in done)), np.int64) for k in (1, 2))
        order = [c for run, *_ in done for c in run]
        fine = np.repeat(np.array([x[3] for x in done], bool), [len(x[0]) for x in done])
        found = align_tokens(self.pair.size_a[flat_a], self.pair.size_b[flat_b])
        ends = np.cumsum(np.where(fine, [len(c.encode()) for c in order], 0))
        group_a, group_b = found.group_a.column, found.group_b.column
        upto = [np.concatenate([[0], np.searchsorted(end, ends, "right")]) for end in (found.end_a, found.end_b)]
        if len(ends) and not np.isin(ends[fine], found.end_a[upto[0][1:][fine] - 1]).all():
            raise AssertionError("a chunk does not end with a token")
        edges = np.concatenate([[0], np.searchsorted(found.common, ends, "right")])
        # the tokens of a group stand side by side, those of A first
        n = found.group_a.width
        before_a, before_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
        after_a = np.concatenate([(group_a[1:] != group_a[:-1]), [True]])[: len(group_a)].astype(np.int64)
        after_b = np.concatenate([(group_b[1:] != group_b[:-1]), [True]])[: len(group_b)] * 2
        after_b[upto[1][1:][fine] - 1] = 3
        words = np.empty(len(flat_a) + len(flat_b), object)
        words[np.arange(len(flat_a)) + before_b[group_a]] = self.pair.written[after_a, flat_a]
        words[np.arange(len(flat_b)) + before_a[group_b + 1]] = self.pair.written[after_b, flat_b]
        listed, bounds = words.tolist(), (upto[0] + upto[1]).tolist()
        self.groups += ["".join(listed[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        link_a, link_b = found.together()
        self.numbers = np.concatenate([self.numbers, [fine, np.diff(upto[0]), np.diff(upto[1]), np.diff(edges)]], axis=1)
        self.first = np.concatenate([self.first, self.first[-1] + np.searchsorted(link_a, upto[0][1:])])
        self.links = np.concatenate([self.links, flat_a[link_a] * SIDE + flat_b[link_b]])
        for c in order:
            self.slot[c] = len(self.slot)
            self.chars += len(c)

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Number of chunks of each text, and their slots."""
        parts = [_CUT.split(" " + t) if t else [] for t in texts]
        if len(self.slot) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self.__init__(self.pair)
        new = set().union(*parts).difference(self.slot)
        if new:
            self.add(sorted(new))
        slot = self.slot.__getitem__
        return np.array([len(p) for p in parts], np.int64), [list(map(slot, p)) for p in parts]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    done = np.cumsum(size)
    return np.repeat(start - (done - size), size) + np.arange(done[-1] if len(done) else 0)


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """One line per row of ``docs``: row (a number), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs with
    how often each is linked (pairs, times; a pair is a * SIDE + b). Store the result before use: rows are numbered per run.

    Links are the overlap links of A and B whose byte ranges end together. Null and empty texts, and texts whose joined tokens
    are not the bytes of a space and the text on either side (such as those with a space mark), have no tokens. Repeated and
    null ids keep their lines, ids their type; other columns are not read; an empty table gives no lines. Texts are cut into
    chunks only where both tokenizers cut on their own; a text without a space is one chunk, aligned in memory that grows with it.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(tokenizers(path_a, path_b))
        for batch in batches:
            all_texts = [t or "" for t in batch.column(2).to_pylist()]
            weight = np.cumsum([len(t) + 1 for t in all_texts]) // BATCH_BYTES
            edges = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(all_texts)] if all_texts else []
            for a, b in zip(edges[:-1], edges[1:]):
                texts = all_texts[a:b]
                size, slots = table.lookup(texts)
                flat = np.fromiter(itertools.chain.from_iterable(slots), np.int64, int(size.sum()))
                bounds = np.concatenate([[0], np.cumsum(size)])
                fine = np.array([table.numbers[0, p].all() and len(p) > 0 for p in slots], bool)
                sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(table.numbers[1:, flat], axis=1)], axis=1)
                n_a, n_b, n_groups = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]) * fine
                digest = [hashlib.sha256(";".join([table.groups[s] for s in p]).encode()).hexdigest() if f else "" for p, f in zip(slots, fine)]
                first, count = table.first[flat], table.first[flat + 1] - table.first[flat]
                owner = np.repeat(np.arange(len(slots)), size)
                code = table.links[_ranges(first, count)]
                doc = np.repeat(owner, count)
                code, doc = code[fine[doc]], doc[fine[doc]]
                n_links = np.bincount(doc, minlength=len(slots)).astype(np.int64)
                order = np.lexsort([code, doc])
                code, doc = code[order], doc[order]
                head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(code))).astype(np.int32)
                at = pa.array(np.searchsorted(doc[head], np.arange(len(slots) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)],
                        pa.array(digest, pa.string()), pa.ListArray.from_arrays(at, pa.array(code[head])), pa.ListArray.from_arrays(at, pa.array(times)),
                    ],
                    names=["row", "doc_id", *numbers, "groups_sha256", "pairs", "times"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, " + ", ".join(f"{c} long" for c in numbers) + ", groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole corpus hold each id pair linked. Tasks add up their own pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            mine, times = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            merged, at = np.unique(np.concatenate([pairs, mine]), return_inverse=True)
            pairs, counts = merged, np.bincount(at, np.concatenate([counts, times]), len(merged)).astype(np.int64)
            if len(pairs) > PAIRS_HELD:
                yield out()
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_report(aligned: DataFrame) -> DataFrame:
    """Per row of ``aligned`` (stored): its columns without the pairs, n_best (links whose pair is the most frequent of its B id, ties
    included) and count_sum (the pairs' counts over all links).

    The counts of the HOT_PAIRS most frequent pairs are broadcast; other pairs meet theirs by a join, whose hottest key is
    bounded by their rank: no key of it has more than links / HOT_PAIRS lines. The best count of a B id is a line a vocabulary entry.
    """
    counts = pair_counts(aligned)
    best = counts.groupBy((F.col("pair") % SIDE).alias("b")).agg(F.max("n").alias("most"))
    judged = cut(counts.withColumn("b", F.col("pair") % SIDE).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    hot = judged.orderBy(F.col("n").desc(), "pair").limit(HOT_PAIRS).toArrow()  # at most HOT_PAIRS lines
    order = np.argsort(hot["pair"].to_numpy())
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def places(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = shared.value[0]
        at = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
        return at, (names[at] == pairs) if len(names) else np.zeros(len(pairs), bool)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times, doc = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, hit = places(pairs)
            best_, sum_ = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(best_, doc[hit], times[hit] * shared.value[2][at[hit]])
            np.add.at(sum_, doc[hit], times[hit] * shared.value[1][at[hit]])
            kept = [batch.column(c) for c in ("row", "doc_id", *numbers, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best_), pa.array(sum_)], names=["row", "doc_id", *numbers, "groups_sha256", "best_hot", "sum_hot"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            rest = ~places(pairs)[1]
            row = np.repeat(batch.column("row").to_numpy(), np.diff(lists.offsets.to_numpy()))[rest]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pairs[rest]), pa.array(times[rest])], names=["row", "pair", "times"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    head = aligned.mapInArrow(frequent, f"row long, doc_id {kind}, " + ", ".join(f"{c} long" for c in numbers) + ", groups_sha256 string, best_hot long, sum_hot long")
    met = aligned.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times int").join(judged, "pair")
    tail = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("best_rare"), F.sum(F.col("n") * F.col("times")).alias("sum_rare"))
    return head.join(tail, "row", "left").select(
        "doc_id", *numbers, (F.col("best_hot") + F.coalesce("best_rare", F.lit(0))).alias("n_best"), (F.col("sum_hot") + F.coalesce("sum_rare", F.lit(0))).alias("count_sum"), "groups_sha256")
