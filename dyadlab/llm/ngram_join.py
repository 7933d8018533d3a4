"""Exact Jaccard self-join of word-shingle sets by universe partition and the pigeonhole principle; classes of near copies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlab.llm.components import components
from dyadlab.llm.storage import Shelf, release
from dyadlab.llm.words import SPACES, Words, mix, pieces, shingle_sets
from dyadlab.session import cut

SHINGLE = 5
SLOTS = 1 << 24  # of the frequency sketch, so that its size is fixed
LEAST = 16  # documents from which a slot counts as met more than once
THIN = 8  # of so many places in which a slot is met, one is told to the sketch
HOT = 6  # level of a frequent shingle (32 documents)
PROFILE = ["kind", "a", "n", "x", "y", "parity", "slots", "counts"]
INDEX, PROBE, PLAIN = 0, 1, 2  # what a document is under a key; the stronger role counts
# a mark holds, from its lowest bit: role (2), frequent share in 255ths (8), step (6)
NO_STEP = 63
KEY_BITS = 48  # of a key; equal keys of unlike segments only cost a verification
BUCKETS = 64  # of the table of candidate texts
PARITY_BITS = 2048  # kept beside a text
SHORT_PARITY_BITS = 256  # of each set, carried by the lines of keys that stay open
FIRST_KEYS = 8  # smallest open keys of each class, carried so that a pair is not formed again under its later keys
CROWD = 64  # classes under an open key from which it takes part in further rounds of single tries
YIELD = 8  # another round follows while one of so many tries links


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h, 11) >> np.uint64(40)).astype(np.int64)


def _differences(n: int) -> int:
    """The most elements in which a set of n elements and a set of similarity 0.75 or more can differ. Two such sets of
    sizes l and s share at least 3/7 (l + s), so they differ in at most (l + s) / 7, and s is at most 4/3 l."""
    return n // 3


def _bands(n: int) -> list[int]:
    """Size bands [4^k, 4^(k+1)) in which a set of n elements is indexed: its own, and the one below if partners can lie there."""
    k = (n.bit_length() - 1) // 2
    return [k] if k == 0 or 3 * n >= 4 * 4**k else [k, k - 1]


def signatures(h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and marks under which a shingle set is filed. Two sets of similarity 0.75 share a key with fitting marks.

    In band k the universe is hashed into 4^(k+1) segments. A set differs from any partner in at most d = n // 3 elements,
    hence in at most d segments, so of any d + 1 segments one is equal in both. A segment costs as much as its rarest
    shingle is frequent; every set takes its d + 1 cheapest segments, ties in hash order, which is one order for all.

    Sets in which fewer than d + 1 segments are not frequent (HOT) take these, and two such sets can still miss each
    other. If they share a shingle that is not frequent, they meet under it: they file each of these too. If not, both
    consist of frequent shingles to 3/4 at least, and all their other shingles differ. What is left of the (n + m) / 7
    differences of a link of sizes n and m is then all by which their frequent shingles may differ (_allowance), and the
    frequent shingles are partitioned by that number: the fewer differences are left, the fewer and larger the segments.
    """
    n = len(h)
    need = _differences(n) + 1
    frequent = level >= HOT
    lacking = False
    keys, marks = [], []
    with np.errstate(over="ignore"):
        for k in _bands(n):
            place, total, cost, _ = _segments(h, 20 + k, 4 ** (k + 1), level)
            plain, price = mix(total + mix(place.astype(np.uint64), 40 + k), 1), cost
            rare = price < HOT
            if rare.sum() >= need:
                chosen = plain[np.lexsort((plain, price))[:need]]
            else:
                chosen, lacking = plain[rare], True
            keys.append(chosen)
        if lacking:
            keys.append(mix(h[~frequent], 7))
        marks.append(np.full(sum(map(len, keys)), PLAIN + 1024 * NO_STEP))
        common = int(frequent.sum())
        if lacking and 4 * common >= 3 * n:
            part = 255 * common // n
            for key, role, step in _frequent_part(h[frequent], _differences(n) - _others(n, part)):
                keys.append(key)
                marks.append(np.full(len(key), role + 4 * part + 1024 * step))
    return np.concatenate(keys), np.concatenate(marks)


def _segments(h: np.ndarray, seed: int, count: int, level: np.ndarray):
    """Of each of ``count`` segments that holds elements: its number, element sum, least level; and the segment of each element."""
    segment = ((mix(h, seed) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((level, segment))
    s = segment[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.add.reduceat(mix(h[order], 3), at), level[order][at], segment


def _others(n: int, part: int) -> int:
    """The fewest shingles that are not frequent in a set of n, of which part / 255, rounded down, are."""
    return max(0, n - ((part + 1) * n - 1) // 255)


def _frequent_part(h: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(keys, role, step) of frequent shingles that may differ by ``most`` from those of a partner.

    Step j is for pairs with 2^(j-1) to 2^j - 1 differences: of 2^(j-1) segments one differs by one shingle at most, so its
    content (PROBE) meets the other's content or one of the other's one-deletion neighbours (INDEX). Empty segments count.
    Step 0 is for equal ones."""
    flat = np.zeros(len(h), np.uint8)
    for step in range(most.bit_length() + 1 if most >= 0 else 0):
        count = 1 << max(step - 1, 0)
        total = np.zeros(count, np.uint64)
        place, sums, _, segment = _segments(h, 60 + step, count, flat)
        total[place] = sums
        total += mix(np.arange(count, dtype=np.uint64), 100 + step)
        yield mix(total, 2), PROBE, step
        if step:
            yield mix(total[segment] - mix(h, 3), 2), INDEX, step


def _parity(h: np.ndarray, bits: int) -> np.ndarray:
    """Of each bit, whether an odd number of the set's shingles fall on it. Each element in which two sets differ flips one
    bit, so sets differ in at least as many elements as their parities in bits."""
    odd = np.bincount((mix(h, 9) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _longs(lines: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * lines.shape[1]), pa.array(lines.reshape(-1)))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (kind 0: id, set size, two set hashes, short parity) and, at the task's end, lines of the frequency sketch (kind 1: slots
    and documents). A slot met c times in a task is told with chance c / THIN, then as max(c, THIN): summed over tasks that
    estimates the documents of a slot without bias, however the table is cut into tasks. The chance is a hash of the slot
    and the task's first id, so a task that is run again says the same."""
    seen, first = np.zeros(SLOTS, np.uint16), 0
    for ids, texts in pieces(batches):
        rows = np.zeros((4, len(ids)), np.int64)
        rows[0] = ids
        parity = np.zeros((len(ids), SHORT_PARITY_BITS // 64), np.int64)
        first = first or int(ids[0])
        for i, s in enumerate(shingle_sets(Words(texts, SPACES), SHINGLE)):
            if len(s):
                slot, parity[i] = _slot(s), _parity(s, SHORT_PARITY_BITS)
                seen[slot] = np.minimum(seen[slot], 65000) + 1
                with np.errstate(over="ignore"):
                    rows[1:, i] = len(s), mix(s, 5).sum(dtype=np.uint64).astype(np.int64), mix(s, 6).sum(dtype=np.uint64).astype(np.int64)
        nothing = pa.nulls(len(ids), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), *map(pa.array, rows), _longs(parity), nothing, nothing], names=PROFILE)
    met = np.flatnonzero(seen)
    with np.errstate(over="ignore"):
        chance = mix(met.astype(np.uint64) + (np.array([first]).astype(np.uint64) << np.uint64(24)), 13) >> np.uint64(32)
    told = met[chance * np.uint64(THIN) < seen[met].astype(np.uint64) << np.uint64(32)]
    for at in range(0, len(told), 1 << 16):
        part = told[at : at + (1 << 16)].astype(np.int32)
        lists = [pa.array([x], pa.list_(pa.int32())) for x in (part, np.maximum(seen[part], THIN).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[pa.array([0], pa.int64())] * 4, pa.nulls(1, pa.list_(pa.int64())), *lists], names=PROFILE)


def _levels(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots met in LEAST documents or more, beyond what chance puts into a slot, and their frequency level, 1 + log2. It
    steers costs, never what is found. At most SLOTS short lines reach the driver, however large the input."""
    load = (profile.filter("kind = 0").agg(F.sum("n")).first()[0] or 0) / SLOTS
    told = profile.filter("kind = 1").select(F.explode(F.arrays_zip("slots", "counts")).alias("s")).select("s.*")
    lines = told.groupBy("slots").agg(F.sum("counts").alias("n")).filter(F.col("n") >= LEAST + load + 3 * (THIN * load) ** 0.5).toArrow()
    return lines.column("slots").to_numpy(), np.log2(lines.column("n").to_numpy() - load).astype(np.uint8) + np.uint8(1)


def _entries(docs: DataFrame, levels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, doc, mark), one line per key of each document; ids are any 64-bit integers. A task files equal sets once: all
    that follows is by class, and any document of a class stands for it."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, what = shared.value
        level = np.zeros(SLOTS, np.uint8)
        level[where] = what
        filed = set()
        for ids, texts in pieces(batches):
            keys, holders, marks = [], [], []
            for i, s in zip(ids, shingle_sets(Words(texts, SPACES), SHINGLE)):
                with np.errstate(over="ignore"):
                    of = len(s), int(mix(s, 5).sum(dtype=np.uint64)), int(mix(s, 6).sum(dtype=np.uint64))
                if len(s) and of not in filed:
                    filed.add(of)
                    k, r = signatures(s, level[_slot(s)])
                    keys.append(k)
                    holders.append(np.full(len(k), i, np.int64))
                    marks.append(r)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(keys) >> np.uint64(64 - KEY_BITS)).astype(np.int64)), pa.array(np.concatenate(holders)), pa.array(np.concatenate(marks).astype(np.int32))], names=["key", "doc", "mark"])

    return docs.mapInArrow(run, "key long, doc long, mark int")


def _with_parity(docs: DataFrame) -> DataFrame:
    """(doc, text, parity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            lines = np.zeros((len(ids), PARITY_BITS // 64), np.int64)
            for i, s in enumerate(shingle_sets(Words(texts, SPACES), SHINGLE)):
                lines[i] = _parity(s, PARITY_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.binary()).cast(pa.string()), _longs(lines)], names=["doc", "text", "parity"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, text string, parity array<long>")


def _possible(pairs: DataFrame, texts: DataFrame, size: DataFrame) -> DataFrame:
    """Those of the pairs whose parities allow a link: they differ in at most a seventh of both sizes together."""
    side = lambda c: texts.select(F.col("doc").alias(c), F.col("parity").alias(f"of_{c}")).hint("merge").join(size.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}")).hint("merge"), c)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    flips = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.filter(flips * 7 <= F.col("n_a") + F.col("n_b")).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of the pairs (a, b): 100 * intersection >= 75 * union, on the sets of the whole texts.

    ``texts`` (doc, text) is bucketed by doc, so only the pairs and the first text are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                one, two = (shingle_sets(Words(part.column(c).cast(pa.binary()).to_pylist(), SPACES), SHINGLE) for c in (2, 3))
                linked = []
                for x, y in zip(one, two):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= 75 * (len(x) + len(y) - common) > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    first = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = first.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    checked = both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")
    return checked.groupBy("a", "b").agg(F.bool_or("linked").alias("linked"))


def _allowance() -> Column:
    """By how many frequent shingles two linked sets may differ that share no other: (n + m) / 7 less all others."""
    others = lambda n, part: F.greatest(F.lit(0), F.col(n) - F.expr(f"(({part} + 1) * {n} - 1) div 255"))
    return F.expr("(n + n2) div 7") - others("n", "part") - others("n2", "part2")


def _fits(a: str, b: str) -> Column:
    return (F.col(a) * 3 <= F.col(b) * 4) & (F.col(b) * 3 <= F.col(a) * 4)


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One line per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents with equal sets are one class, represented by its smallest id, before any pair is formed. Representatives
    are filed under their signatures; keys held by one class only are dropped. First each key links its classes to its
    smallest one and each class tries the one it shares most keys with (one pair per class), which joins a group of near
    copies without forming its pairs. Where crowded keys stay open, rounds follow in which each class tries one other, while
    they link. Then every pair of classes that share a key and are not yet in one component is verified, whatever the key's
    size: no partner is capped, so components are exact, and rounds only spare pairs that need no proof any more. Documents without words are linked with nothing. Null ids are left out;
    rows that repeat an id are one document that links by any of its texts.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    candidates = f"near_copy_texts_{uuid.uuid4().hex}"
    with Shelf(docs.sparkSession) as shelf:
        try:
            member, links = _links(docs, shelf, candidates)
        finally:
            docs.sparkSession.sql(f"DROP TABLE IF EXISTS {candidates}")
        found = cut(components(links))
        out = cut(member.join(found, member.rep == found.node, "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))
    release(docs.sparkSession)
    return out


def _links(docs: DataFrame, shelf: Shelf, candidates: str) -> tuple[DataFrame, DataFrame]:
    """(doc, n, parity, rep) of every document and the links (a, b) of representatives. Each result is written before the next is
    begun, and functions of their own build them, so that nothing holds on to the shuffles behind them."""
    profile = shelf.put(docs.mapInArrow(_profile, "kind int, a long, n long, x long, y long, parity array<long>, slots array<int>, counts array<int>"))
    member = shelf.put(_members(profile))
    levels = _levels(profile)
    shelf.drop(profile)
    held = shelf.put(_held(docs, levels))
    folded = shelf.put(_folded(held, member))
    shelf.drop(held)
    filed = shelf.put(_filed(folded))
    sizes = shelf.put(folded.groupBy(F.col("rep").alias("doc")).agg(F.max("n").alias("n")))
    shelf.drop(folded)
    stars = shelf.put(_stars(filed))
    # one exchange of the texts: the join and the buckets use the same partitions
    wanted = filed.select(F.col("rep").alias("doc")).distinct()
    chosen = docs.repartition(BUCKETS, "doc").join(wanted.repartition(BUCKETS, "doc").hint("merge"), "doc", "left_semi")
    _with_parity(chosen).write.bucketBy(BUCKETS, "doc").sortBy("doc").format("parquet").saveAsTable(candidates)
    del chosen, wanted
    release(docs.sparkSession)
    texts = docs.sparkSession.table(candidates)
    tried = shelf.put(_verified(_possible(stars, texts, sizes), texts))
    links = tried.filter("linked").select("a", "b")
    label = cut(components(links))
    label, links = _rounds(filed, label, links, member, texts, sizes, shelf)
    left = shelf.put(_open_lines(filed, label, member))
    shelf.drop(filed)
    rest = shelf.put(_open_pairs(left, stars))
    shelf.drop(left)
    more = shelf.put(_verified(_possible(rest, texts, sizes), texts)).filter("linked").select("a", "b")
    return member, links.unionByName(more)


def _members(profile: DataFrame) -> DataFrame:
    sets = profile.filter("kind = 0").select(F.col("a").alias("doc"), "n", "x", "y", "parity")
    classes = sets.filter("n > 0").groupBy("n", "x", "y").agg(F.min("doc").alias("rep"))
    return sets.join(classes, ["n", "x", "y"], "left").select("doc", "n", "parity", F.coalesce("rep", "doc").alias("rep"))


def _held(docs: DataFrame, levels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, doc, role, part, step): the entries of keys held by two documents or more, keys of the same holders made one."""
    doc, bits = F.col("doc"), lambda at, width: F.pmod(F.shiftright("mark", at), F.lit(1 << width)).cast("int")
    under = Window.partitionBy("key")
    held = _entries(docs, levels).select("key", "doc", "mark", F.count(F.lit(1)).over(under).alias("holders"), F.sum(F.pmod(F.xxhash64(doc), F.lit(1 << 31))).over(under).alias("rough"), F.bit_xor(F.xxhash64(doc)).over(under).alias("group")).filter("holders > 1")
    # keys of a step held by the same documents are one: what counts is the group, and how many keys it shares
    return held.select(F.xxhash64("holders", "rough", "group", bits(10, 6)).alias("key"), doc.alias("doc"), bits(0, 2).alias("role"), bits(2, 8).alias("part"), bits(10, 6).alias("step"))


def _folded(held: DataFrame, member: DataFrame) -> DataFrame:
    """(key, rep, role, part, step, votes, n): one line per key and class."""
    shared = held.groupBy("key", "doc").agg(F.max("role").alias("role"), F.max("part").alias("part"), F.min("part").alias("part_low"), F.max("step").alias("step"), F.count(F.lit(1)).alias("votes"))
    # copies fold into their class; where a repeated id makes two sets one line, the steps say nothing and the key is plain
    folded = shared.join(member.select("doc", "n", "rep").distinct(), "doc").groupBy("key", "rep").agg(
        F.max("role").alias("role"), F.max("part").alias("part"), F.max("step").alias("step"), F.max("votes").alias("votes"), F.max("n").alias("n"),
        ((F.min("part_low") < F.max("part")) | (F.min("n") < F.max("n"))).alias("several"))
    return folded.withColumn("role", F.when(F.col("several"), PLAIN).otherwise(F.col("role"))).drop("several")


def _filed(folded: DataFrame) -> DataFrame:
    least = folded.groupBy("key").agg(F.min("rep").alias("low"), F.min_by("n", "rep").alias("low_n"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return folded.join(least, "key")


def _stars(filed: DataFrame) -> DataFrame:
    stars = filed.filter((F.col("rep") != F.col("low")) & _fits("n", "low_n")).groupBy("low", "rep").agg(F.sum("votes").alias("votes"))
    return stars.groupBy("rep").agg(F.max_by("low", F.struct("votes", -F.col("low"))).alias("low")).select(F.col("low").alias("a"), F.col("rep").alias("b"))


def _labelled(filed: DataFrame, label: DataFrame) -> DataFrame:
    return filed.join(label, filed.rep == label.node, "left").select("key", "rep", "role", "part", "step", "n", F.coalesce("component", "rep").alias("component"))


def _short(member: DataFrame) -> DataFrame:
    """(of, parity) of each class; a repeated id with two sets has no parity of its own, and its pairs go on to be verified."""
    return member.groupBy(F.col("rep").alias("of")).agg(F.when(F.min("parity") == F.max("parity"), F.min("parity")).alias("parity"))


def _flips() -> Column:
    return sum(F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity2")[i])) for i in range(SHORT_PARITY_BITS // 64))


def _crowded(filed: DataFrame, label: DataFrame, member: DataFrame) -> DataFrame:
    """(key, rep, role, n, parity): the filed lines of keys under which many classes of several components meet."""
    left = _labelled(filed, label)
    crowds = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("lines")).filter((F.col("lo") < F.col("hi")) & (F.col("lines") >= CROWD)).select("key")
    short = _short(member)
    lines = left.join(crowds, "key").select("key", "rep", "role", "n")
    return lines.join(short, lines.rep == short.of).drop("of")


def _tries(lines: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), one per class at most: each key names one of its classes, another one every ``turn``, and each class tries
    the one that its parity is nearest to, of those in other components that it can be linked with."""
    lines = lines.join(label, lines.rep == label.node, "left").select("key", "rep", "role", "n", "parity", F.coalesce("component", "rep").alias("component"))
    told = F.when(F.col("role") != INDEX, F.struct(*[F.col(c).alias(f"{c}2") for c in ("rep", "n", "parity", "component")]))
    order = F.when(F.col("role") != INDEX, F.xxhash64("rep", F.lit(turn)))
    named = lines.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(told, order).alias("t")).filter("lo < hi AND t IS NOT NULL").select("key", "t.*")
    near = lines.join(named, "key").filter((F.col("component") != F.col("component2")) & _fits("n", "n2")).withColumn("flips", F.coalesce(_flips(), F.lit(0))).filter(F.col("flips") * 7 <= F.col("n") + F.col("n2"))
    best = near.groupBy("rep").agg(F.min(F.struct("flips", "rep2")).alias("t")).select("rep", "t.rep2")
    return best.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def _rounds(filed: DataFrame, label: DataFrame, links: DataFrame, member: DataFrame, texts: DataFrame, sizes: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(label, links) after rounds of tries under crowded keys. They join groups whose smallest class is not near to all, each
    with pairs in proportion to its classes; what is found are links, and what is not found is left to :func:`_open_pairs`."""
    lines, turn = shelf.put(_crowded(filed, label, member)), 0
    while True:
        pairs = shelf.put(_tries(lines, label, turn))
        tried = pairs.count()
        linked = 0
        if tried:
            found = shelf.put(_verified(_possible(pairs, texts, sizes), texts).filter("linked").select("a", "b"))
            links, linked = links.unionByName(found), found.count()
        if linked:
            label = cut(components(links))
        if linked * YIELD <= tried:
            shelf.drop(lines)
            return label, links
        turn += 1


def _open_lines(filed: DataFrame, label: DataFrame, member: DataFrame) -> DataFrame:
    """The filed lines of keys whose classes are not all in one component yet."""
    left = _labelled(filed, label)
    open_keys = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    short = _short(member)
    left = left.join(open_keys, "key")
    # the smallest plain keys of each class; bounded by the keys of one document
    first = left.filter(F.col("role") == PLAIN).groupBy(F.col("rep").alias("of")).agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("first"))
    # and the smallest contents (PROBE) of each class by step; where a repeated id makes its lines tell different things, none
    alike = (F.min("part") == F.max("part")) & (F.min("n") == F.max("n"))
    contents = F.slice(F.sort_array(F.collect_set(F.when(F.col("role") == PROBE, F.col("key")))), 1, FIRST_KEYS)
    first_step = left.filter(F.col("role") != PLAIN).groupBy(F.col("rep").alias("of"), F.col("step").alias("of_step")).agg(F.when(alike, contents).alias("first_step"))
    none = F.array().cast("array<bigint>")
    told = left.join(short, left.rep == short.of).drop("of")
    told = told.join(first, told.rep == first.of, "left").drop("of").withColumn("first", F.coalesce("first", none))
    stepped = told.join(first_step, (told.rep == first_step.of) & (told.step == first_step.of_step) & (told.role != PLAIN), "left").drop("of", "of_step")
    return stepped.withColumn("first_step", F.coalesce("first_step", none))


def _open_pairs(left: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that meet under an open key, can be linked and have not been tried.

    Two classes may share many keys. Of the keys that both have among their first plain ones, only the smallest forms their
    pair: elsewhere each line knows which of them came ``before``, and a common one means that the pair exists. So it is with
    the first contents of a step: a pair belongs to one step, and where both hold a content of it their pair is formed. Classes
    without such a key meet under each that they share, so no pair is lost whatever FIRST_KEYS is."""
    before = F.when(F.col("role") == PLAIN, F.filter("first", lambda k: k < F.col("key"))).otherwise(F.col("first"))
    before_step = F.when(F.col("role") == PROBE, F.filter("first_step", lambda k: k < F.col("key"))).otherwise(F.col("first_step"))
    left = left.withColumns({"before": before, "before_step": before_step}).drop("first", "first_step")
    other = left.select("key", *[F.col(c).alias(f"{c}2") for c in ("rep", "role", "part", "n", "parity", "component", "before", "before_step")])
    left_over = _allowance()
    met = (F.col("role") == PLAIN) | (F.col("role2") == PLAIN) | (((F.col("role") == PROBE) | (F.col("role2") == PROBE)) & (left_over >= 0) & (F.col("step") == F.when(left_over == 0, 0).otherwise(F.length(F.bin(left_over)))))
    met = met & F.coalesce(_flips() * 7 <= F.col("n") + F.col("n2"), F.lit(True)) & ~F.arrays_overlap("before", "before2")
    # a plain line has no step and its list is empty
    met = met & ~F.arrays_overlap("before_step", "before_step2")
    rest = left.join(other, "key").filter((F.col("rep") < F.col("rep2")) & (F.col("component") != F.col("component2")) & _fits("n", "n2") & met)
    return rest.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
