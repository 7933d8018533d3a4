"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.llm.words import MARKS, Words, pieces

WINDOW = 10  # consecutive item words that make a hit; a shorter item is hit as a whole
SHARD_WORDS = 500_000  # item words per automaton, which bounds what one broadcast holds


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows the items whose windows end there."""

    def __init__(self, window: int):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.items: list[set[int]] = [set()]  # items with an occurrence ending in the state
        self.short: list[list[tuple[int, int]]] = [[]]  # (length, item) of short items that are the state's string

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.short.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        state, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return state

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def mark(self, item: int, words: list[int]) -> None:
        """After all ``add`` calls: note where the item's windows end (states are final only then)."""
        state = matched = 0
        for w in words:
            state, matched = self.next[state][w], matched + 1
            at = state
            if len(words) >= self.window and matched >= self.window:
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                self.items[at].add(item)
        if 0 < len(words) < self.window:
            while self.length[self.link[state]] >= len(words):
                state = self.link[state]
            self.short[state].append((len(words), item))

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of a word sequence, in order and merged, and the items that occur in it."""
        state = matched = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            reach, at = 0, state
            if matched >= self.window:
                reach = matched
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                found |= self.items[at]
            while at > 0:  # shorter suffixes that are whole short items
                for length, item in self.short[at]:
                    if length <= matched:
                        reach = max(reach, length)
                        found.add(item)
                at = self.link[at]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def _known(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = words.hashes()
    at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
    return at, (vocabulary[at] == h) if len(vocabulary) else np.zeros(len(h), bool)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: bool = False) -> DataFrame:
    """One line per document: doc_id, n_words, hits, items, bytes. With ``carry`` every row of ``docs`` has a line, null ids included,
    and ``row``, a struct of all its columns, stands in the place of doc_id.

    Words are runs of a-z, 0-9 and non-ASCII of the lower-cased text. A window is ``window`` consecutive words of an
    item, or all words of a shorter one. ``hits`` are the merged word spans [start, end) inside any occurrence of a
    window, ``bytes`` the same as places in the UTF-8 text, ``items`` the ids with an occurring window.
    Documents are streamed through the automaton in the order of the scan, without a shuffle; only runs of words that
    are all known to it, at least as long as the shortest window, are walked. The items are split by id so that no
    automaton has more than SHARD_WORDS words (one item at least); the documents' pass goes through one after another,
    so the broadcast of one pass is bounded whatever the benchmark's size.
    Null or empty texts have no words and no hits; null ids are left out; repeated rows give repeated lines; without
    items nothing is hit. Item ids are integers; null ids or texts have no windows.
    """
    spark = docs.sparkSession
    counted = benchmark.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    total = counted.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.lit(None).cast("boolean").alias("row")
    name = F.lit(0).cast("long") if carry else F.col(key).cast("long")
    out = docs.select(name.alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), *[F.array().cast(t).alias(c) for c, t in (("hits", "array<struct<start:int,end:int>>"), ("items", "array<long>"), ("bytes", "array<struct<start:int,end:int>>"))], own)
    for shard in range(shards):
        rows = counted.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).collect()  # about SHARD_WORDS words
        automaton = SuffixAutomaton(window)
        parsed = Words([r.text.encode() for r in rows], MARKS)
        vocabulary, ids = np.unique(parsed.hashes(), return_inverse=True)
        sequences = [ids[a:b].tolist() for a, b in zip(parsed.first[:-1], parsed.first[1:])]
        for s in sequences:
            automaton.add(s)
        for r, s in zip(rows, sequences):
            automaton.mark(r.item, s)
        least = min([window, *(len(s) for s in sequences if s)])
        shared = spark.sparkContext.broadcast((automaton, vocabulary))

        def walk(batches: Iterator[pa.RecordBatch], shared=shared, least=least, last=shard == shards - 1) -> Iterator[pa.RecordBatch]:
            automaton, vocabulary = shared.value
            for batch in batches:
                before = batch.slice(0, batch.num_rows)
                if before.column(0).null_count:
                    before = before.filter(before.column(0).is_valid())
                earlier = iter(zip(before.column(3).to_pylist(), before.column(4).to_pylist()))
                done: dict[str, list] = {c: [] for c in ("doc_id", "text", "n_words", "hits", "items", "bytes")}
                place = 0
                for keys, texts in pieces(iter([before])):
                    words = Words(texts, MARKS)
                    at, known = _known(words, vocabulary)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).view(np.int8)))
                    bounds = np.unique(np.concatenate([edge, words.first[1:-1]])) if len(edge) else edge
                    found: dict[int, tuple[list, set]] = {}
                    begin, end = bounds[:-1], bounds[1:]  # a run does not cross texts
                    long = (end - begin >= least) & known[np.minimum(begin, len(known) - 1)] if len(known) else np.zeros(0, bool)
                    for a, b in zip(begin[long], end[long]):
                        spans, items = automaton.stream(at[a:b].tolist())
                        if spans:
                            d = int(np.searchsorted(words.first, a, "right")) - 1
                            hit = found.setdefault(d, ([], set()))
                            hit[0].extend((int(a) + s, int(a) + e) for s, e in spans)
                            hit[1].update(items)
                    for d, (k, t) in enumerate(zip(keys, texts)):
                        old, old_items = next(earlier)
                        first = int(words.first[d])
                        hits, items = found.get(d, ([], set()))
                        hits = _merge([(s - first, e - first) for s, e in hits] + [(x["start"], x["end"]) for x in old])
                        base = int(words.text_start[d])
                        done["doc_id"].append(int(k))
                        done["text"].append(None if last else t)
                        done["n_words"].append(int(words.first[d + 1]) - first)
                        done["hits"].append([{"start": s, "end": e} for s, e in hits])
                        done["items"].append(sorted(items | set(old_items)))
                        done["bytes"].append([{"start": int(words.start[first + s]) - base, "end": int(words.end[first + e - 1]) - base} for s, e in hits])
                    place += len(texts)
                if place != before.num_rows:
                    raise AssertionError("a row was lost")
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                kinds = {"doc_id": pa.int64(), "text": pa.string(), "n_words": pa.int64(), "hits": span, "items": pa.list_(pa.int64()), "bytes": span}
                yield pa.RecordBatch.from_arrays([*[pa.array(done[c], pa.binary()).cast(pa.string()) if c == "text" else pa.array(done[c], kinds[c]) for c in done], before.column(6)], names=[*done, "row"])

        out = out.mapInArrow(walk, "doc_id long, text string, n_words long, hits array<struct<start:int,end:int>>, items array<long>, bytes array<struct<start:int,end:int>>, row " + out.schema["row"].dataType.simpleString())
    return out.drop("text", "doc_id") if carry else out.drop("text", "row")


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def report(overlaps: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return overlaps.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, overlaps: DataFrame, key: str = "doc_id", text: str = "text", max_span: int = 0, max_coverage: float = 1.0) -> DataFrame:
    """``docs`` without hit spans of more than ``max_span`` words; documents hit in more than ``max_coverage`` of their
    words are dropped altogether (0: every hit document goes)."""
    hit = F.aggregate("hits", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    long = F.filter(F.arrays_zip("hits", "bytes"), lambda z: z["hits"]["end"] - z["hits"]["start"] > max_span)
    marked = overlaps.filter(F.size("hits") > 0).groupBy("doc_id").agg(F.first(hit / F.greatest("n_words", F.lit(1))).alias("__coverage"), F.first(F.transform(long, lambda z: z["bytes"])).alias("__spans"))
    joined = docs.alias("d").join(marked.alias("m"), F.col(f"d.{key}") == F.col("m.doc_id"), "left").filter(F.coalesce(F.col("m.__coverage"), F.lit(0.0)) <= max_coverage)
    raw = F.encode(F.col(f"d.{text}"), "UTF-8")
    pieces_ = F.aggregate("m.__spans", F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out")), lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(raw, a["at"] + 1, s["start"] - a["at"])).alias("out")))
    cleaned = F.decode(F.concat(pieces_["out"], F.substring(raw, pieces_["at"] + 1, F.octet_length(raw))), "UTF-8")
    return joined.select(*[F.when(F.size("m.__spans") > 0, cleaned).otherwise(F.col(f"d.{text}")).alias(text) if c == text else F.col(f"d.`{c}`") for c in docs.columns])

