"""Cluster bootstrap of ranking statistics: replicate weights are carried along the order, rows are never copied.

Rows are dealt into narrow score ranges whose bounds are known beforehand. Where the units of some blocks are drawn, the weights of their
rows are cut by range and by ``LANES`` replicates and travel as one packed matrix each, half a byte a weight. A task then has all rows
for its replicates, range after range, orders one range at a time and carries the running sums on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import resample as B
from dyadlab.operators.ordering import positions
from dyadlab.operators.pairs import UNIT
from dyadlab.operators.tree_bootstrap import SLICE, Draws, _blocks, arrow_kinds, grow, laid_out, unit_index
from dyadlab.session import cut, release, shuffle_width

N = S.number
LANES = 100  # replicates that travel together and are scanned by one task, a divisor of SLICE
SCAN_LINES = 8192  # rows of a score range, on average
SENT_UNITS = 1 << 15  # units whose rows are folded and sent together
STORED_WEIGHTS = 4_000_000_000  # weights (half a byte each) that lie on disk at a time, unless one slice has more
MOST_SCANS = 128  # partitions of the scans, unless the session has more
RANKING, COVERAGE = ("auroc", "average_precision"), ("aurc",)
_SENT = "_code int, _part int, _lane int, _range int, _place binary, _flag binary, _width int, _data binary"
_SENT_KINDS = pa.schema([("_code", pa.int32()), ("_part", pa.int32()), ("_lane", pa.int32()), ("_range", pa.int32()), ("_place", pa.binary()), ("_flag", pa.binary()), ("_width", pa.int32()), ("_data", pa.binary())])


def _packed(weights: np.ndarray) -> tuple[int, np.ndarray]:
    """Bytes of a weight (0: half a byte, lanes j and j + LANES / 2 share one) and the weights as bytes, a line a row."""
    top = int(weights.max(initial=0))
    if top < 16:
        small = weights.astype(np.uint8)
        return 0, small[:, : LANES // 2] | small[:, LANES // 2 :] << 4
    kind = np.min_scalar_type(top)
    return kind.itemsize, np.ascontiguousarray(weights, kind).view(np.uint8)


def _unpacked(width: int, data: bytes) -> np.ndarray:
    if width:
        return np.frombuffer(data, f"<u{width}").reshape(-1, LANES)
    both = np.frombuffer(data, np.uint8).reshape(-1, LANES // 2)
    return np.concatenate([both & 15, both >> 4], 1)


def _folded(weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the lines from each ``begin`` to the next. Bytes are first added four at a time, as many lines as cannot overflow."""
    step = 255 // max(1, int(weights.max(initial=0)))
    if weights.dtype == np.uint8 and step > 1:
        pieces = -(-np.diff(np.append(begin, len(weights))) // step)
        first = np.cumsum(pieces) - pieces
        spots = np.repeat(begin - first * step, pieces) + np.arange(pieces.sum()) * step
        weights, begin = np.add.reduceat(np.ascontiguousarray(weights).view(np.uint32), spots, axis=0, dtype=np.uint32).view(np.uint8), first
    return np.add.reduceat(weights, begin, axis=0, dtype=np.int64)


def score_ranges(rows: DataFrame, score: str, keys: Sequence[str], count: int) -> DataFrame:
    """(keys, _rows, _distinct, _bounds): up to ``count`` - 1 ascending bounds per key, approximate quantiles. Bounds steer the spread over
    tasks, never the result: rows of equal score fall into one range."""
    shares = [i / count for i in range(1, count)]
    bounds = F.percentile_approx(score, shares, max(1000, 5 * count)) if shares else F.array().cast("array<double>")
    found = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.approx_count_distinct(score).alias("_distinct"), bounds.alias("_bounds"))
    return found.withColumn("_bounds", F.array_sort(F.array_distinct("_bounds")))


class _Rows:
    """Rows of some blocks, to be sent by range: key, range, place in the order, flag, and the unit among the units of these blocks."""

    def __init__(self, code: np.ndarray, place: np.ndarray, positive: np.ndarray, unit: np.ndarray, bounds: Sequence[np.ndarray] | int):
        at = _ranges(code, place, bounds)
        order = np.lexsort([positive, place, at, code])
        self.code, self.at, self.place, self.positive, self.unit = (x[order] for x in (code, at, place, positive, unit))
        edges = np.flatnonzero(np.diff(self.code, prepend=-1))
        self.keys = [self._key(a, b, not isinstance(bounds, int)) for a, b in zip(edges, [*edges[1:], len(order)])]

    def _key(self, a: int, b: int, fold: bool):
        at, place, positive = self.at[a:b], self.place[a:b], self.positive[a:b]
        new = np.ones(b - a, bool)
        new[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1]) | (positive[1:] != positive[:-1])
        begin = np.flatnonzero(new)
        folds = fold and 2 * len(begin) <= b - a  # else rows go as they are
        if folds:
            at, place, positive = at[begin], place[begin], positive[begin]
        edges = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        ends = [*edges[1:].tolist(), len(at)]
        return int(self.code[a]), self.unit[a:b], begin if folds else None, [(int(at[i]), i, j, place[i:j].tobytes(), positive[i:j].tobytes()) for i, j in zip(edges.tolist(), ends)]

    def sent(self, weights: np.ndarray, part: int, replicates: int) -> Iterator[pa.RecordBatch]:
        """Lines of all keys, ranges and lanes in use; ``weights`` has a line a unit and a column a replicate of the slice."""
        for lane in range(min(SLICE, replicates - part * SLICE + LANES - 1) // LANES):
            of_units = np.ascontiguousarray(weights[:, lane * LANES : (lane + 1) * LANES])
            for code, unit, begin, ranges in self.keys:
                lines = of_units[unit]
                width, data = _packed(lines if begin is None else _folded(lines, begin))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v] * len(ranges), pa.int32()) for v in (code, part, lane)], pa.array([r[0] for r in ranges], pa.int32()), pa.array([r[3] for r in ranges], pa.binary()),
                     pa.array([r[4] for r in ranges], pa.binary()), pa.array([width] * len(ranges), pa.int32()), pa.array([data[i:j].tobytes() for _, i, j, *_ in ranges], pa.binary())],
                    schema=_SENT_KINDS)


_SMALL = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 256))])


def _harmonic(x: np.ndarray) -> np.ndarray:
    """Sum of 1 / c for c from 1 to x, of whole numbers x."""
    y = 1.0 / np.maximum(x, 1.0)
    out = np.euler_gamma - np.log(y) + y * (0.5 - y * (1 / 12 - y * y / 120))
    small = x < len(_SMALL)
    if small.any():
        out[small] = _SMALL[x[small].astype(np.int64)]
    return out


def _running(weights: np.ndarray) -> np.ndarray:
    """Running sums along the lines for each lane, from zero: lanes x (lines + 1)."""
    out = np.zeros((LANES, len(weights) + 1), np.int32 if len(weights) * int(weights.max(initial=0)) < 1 << 31 else np.int64)
    np.cumsum(np.ascontiguousarray(weights.T), 1, dtype=out.dtype, out=out[:, 1:])
    return out


class _Scan:
    """Running sums over the ranges of one key for LANES replicates, in order; equal scores count as one step of the ranking."""

    def __init__(self):
        self.first, self.second = np.zeros(LANES), np.zeros(LANES)  # weights so far of flagged lines, and of the others
        self.out = np.zeros((2, LANES))
        self.mark = np.zeros(LANES)

    def _sides(self, positive: np.ndarray, weights: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return weights[order[positive[order]]], weights[order[~positive[order]]]

    def rank(self, place: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> None:
        """Of the pairs of a positive and a negative, those in wrong order (half of ties), and the steps of precision."""
        order = np.argsort(-place, kind="stable")
        p, q = self._sides(positive, weights, order)
        falls = -place[order]
        of_p, of_q = falls[positive[order]], falls[~positive[order]]
        negatives = _running(q)
        if len(p):
            positives, flagged = _running(p), p.T.astype(np.float64)
            above, upto = np.searchsorted(of_q, of_p, "left"), np.searchsorted(of_q, of_p, "right")
            fp = negatives.take(upto, 1) + self.second[:, None]
            middle = fp if (above == upto).all() else (fp + negatives.take(above, 1) + self.second[:, None]) / 2
            self.out[0] += np.einsum("ij,ij->i", flagged, middle)
            tp = positives.take(np.searchsorted(of_p, of_p, "right"), 1) + self.first[:, None]
            fp += tp
            np.maximum(fp, 1.0, out=fp)
            tp /= fp
            self.out[1] += np.einsum("ij,ij->i", flagged, tp)
            self.first = self.first + positives[:, -1]
        self.second = self.second + negatives[:, -1]

    def cover(self, place: np.ndarray, error: np.ndarray, weights: np.ndarray) -> None:
        """A row of weight w stands for w rows in a row: the mean error so far is added after each of them. It is errors / rows, so rows
        without an error add the errors so far times a difference of harmonic numbers, and a row with one adds 1 - correct rows / rows."""
        order = np.argsort(place, kind="stable")
        p, q = self._sides(error, weights, order)
        right = _running(q)
        if len(p):
            wrong, own = _running(p), p.T.astype(np.float64)
            errors = wrong[:, :-1] + self.first[:, None]
            correct = right.take(np.cumsum(~error[order])[error[order]], 1) + self.second[:, None]
            before = _harmonic(errors + correct)
            after = _harmonic(errors + correct + own)
            self.out[0] += (own - correct * (after - before)).sum(1)
            last = np.concatenate([self.mark[:, None], after[:, :-1]], 1)
            self.out[0] += np.einsum("ij,ij->i", errors, before - last)
            self.mark = after[:, -1]
            self.first = self.first + wrong[:, -1]
        self.second = self.second + right[:, -1]

    def ranked(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which replicates have both classes, and their AUROC and average precision."""
        usable = (self.first > 0) & (self.second > 0)
        p, q = np.where(usable, self.first, 1.0), np.where(usable, self.second, 1.0)
        return usable, [(p * q - self.out[0]) / (p * q), self.out[1] / p]

    def covered(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = self.first + self.second
        total = self.out[0] + self.first * (_harmonic(rows) - self.mark)
        return rows > 0, [total / np.maximum(rows, 1.0)]


class _Order:
    """Where rows stand: keys by number, the bounds of their score ranges (coverage: places in the order, ranges of equal size)."""

    def __init__(self, rows: DataFrame, flag: str, score: str, keys: Sequence[str], unit: str, coverage: bool = False, order: Sequence[str] = ()):
        wanted = rows.filter(F.col(unit).isNotNull() & F.col(flag).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        plain = wanted.select(*keys, unit, F.col(flag).cast("int").alias("_flag"), F.col(score).cast("double").alias("_score"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
        if coverage:
            plain = positions(plain, ["_score", *[f"_order{i}" for i in range(len(order))]], keys).select(*keys, unit, "_flag", F.col("pos").cast("double").alias("_score"))
        else:
            plain = cut(plain)
        most = plain.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        found = score_ranges(plain, "_score", keys, 1 if coverage else max(1, -(-most // SCAN_LINES)))
        lines = [r for r in (found.orderBy(*keys) if keys else found).collect() if r["_rows"] and all(r[k] is not None for k in keys)]  # one line a key
        self.keys, self.names, self.coverage = [tuple(r[k] for k in keys) for r in lines], list(keys), coverage
        self.kinds, self.lead = arrow_kinds(plain, keys)
        self.bounds = SCAN_LINES if coverage else [np.array(r["_bounds"], np.float64) for r in lines]
        self.sizes = [(r["_rows"], r["_distinct"]) for r in lines]
        numbered = rows.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(self.keys)], f"{self.lead}_code int")
        dealt = plain.join(F.broadcast(numbered), list(keys)) if keys else plain.withColumn("_code", F.lit(0))
        self.dealt = dealt.select(*keys, unit, "_code", "_score", "_flag")

    def stored(self, units: int) -> int:
        """About how many lines of one replicate travel, once equal scores are folded where they are many."""
        times = -(-units // SENT_UNITS)
        return sum(min(n, n if self.coverage else 3 * d * times) for n, d in self.sizes)


def _ranges(code: np.ndarray, place: np.ndarray, bounds: Sequence[np.ndarray] | int) -> np.ndarray:
    """Number of each row's range, rising in the order of the scan; places have ranges of one size."""
    if isinstance(bounds, int):
        return (place // bounds).astype(np.int64)
    out = np.zeros(len(code), np.int64)
    for c in np.unique(code):
        out[code == c] = -np.searchsorted(bounds[c], place[code == c], "left")
    return out


def _scanned(lines: DataFrame, found: _Order, parts: Sequence[int], replicates: int) -> DataFrame:
    """(keys, replicate, statistics) from the lines of some slices: each key and LANES replicates are scanned by one task."""
    spark, lanes, first = lines.sparkSession, SLICE // LANES, parts[0]
    scans = max(1, len(found.keys)) * len(parts) * lanes
    width = max(1, min(scans, max(MOST_SCANS, shuffle_width(spark))))
    scan_of = ((F.col("_code") * len(parts) + (F.col("_part") - first)) * lanes + F.col("_lane")) % width
    names = COVERAGE if found.coverage else RANKING
    keys, kinds, coverage, key_names = found.keys, found.kinds, found.coverage, found.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Scan | None = None
        at: tuple | None = None
        held: list[tuple] = []

        def fold() -> None:
            if held:
                place = np.concatenate([np.frombuffer(h[0]) for h in held])
                flag = np.concatenate([np.frombuffer(h[1], bool) for h in held])
                weights = np.concatenate([_unpacked(h[2], h[3]) for h in held])
                held.clear()
                (state.cover if coverage else state.rank)(place, flag, weights)

        def out() -> pa.RecordBatch:
            fold()
            code, part, lane, _ = at
            usable, statistics = state.covered() if coverage else state.ranked()
            replicate = np.arange(LANES) + part * SLICE + lane * LANES
            keep = np.flatnonzero(usable & (replicate < replicates))
            columns = [pa.array([v] * len(keep), kinds[c]) for c, v in zip(key_names, keys[code])]
            return pa.RecordBatch.from_arrays([*columns, pa.array(replicate[keep].astype(np.int32)), *[pa.array(s[keep]) for s in statistics]], names=[*key_names, "replicate", *names])

        for batch in batches:
            for code, part, lane, range_, *line in zip(*(batch.column(c).to_pylist() for c in ("_code", "_part", "_lane", "_range", "_place", "_flag", "_width", "_data"))):
                here = code, part, lane, range_
                if here != at:
                    if state is not None and at[:3] != here[:3]:
                        yield out()
                        state = None
                    elif state is not None:
                        fold()
                    state, at = state or _Scan(), here
                held.append(line)
        if state is not None:
            yield out()

    dealt = lines.repartitionById(width, scan_of.cast("int")).sortWithinPartitions("_code", "_part", "_lane", "_range")
    return dealt.mapInArrow(scan, f"{found.lead}replicate int, " + ", ".join(f"{c} double" for c in names))


def _together(rows: DataFrame, found: _Order, units: int, replicates: int, lines_of) -> DataFrame:
    """Statistics of all replicates; the weights of a few slices at a time lie on disk, what is kept of each group is a line a replicate."""
    slices = range(-(-replicates // SLICE))
    together = max(1, STORED_WEIGHTS // max(1, found.stored(units) * SLICE))
    out: list[DataFrame] = []
    for at in range(0, len(slices), together):
        parts = slices[at : at + together]
        finished = _scanned(lines_of(parts), found, parts, replicates)
        if together >= len(slices):
            return finished
        out.append(cut(finished))
        del finished
        release(rows.sparkSession)
    return reduce(DataFrame.unionByName, out)


def replicate_statistics(
    rows: DataFrame, flag: str, score: str, replicates: int, seed: int, keys: Sequence[str] = ("endpoint",), populations: Sequence[str] = (), unit: str = UNIT, coverage: bool = False, order: Sequence[str] = (),
) -> DataFrame:
    """(keys, replicate, statistics) of every replicate; a replicate that lacks a class (ranking) or any row has no line.

    Ranking (the default): AUROC, ties counting half, and average precision over distinct scores, by falling ``score``; ``flag`` is
    1 for positives, 0 for negatives. Coverage: the area under the risk-coverage curve by rising ``score``, then ``order`` (which
    must make rows distinct); ``flag`` is 1 for an error. All rows of a unit share its weights. Rows with null units, flags or scores
    are left out. Equal scores of some blocks are folded before they are shuffled (ranking).
    """
    found = _Order(rows, flag, score, keys, unit, coverage, order)
    marked, tree = grow(found.dealt, populations, unit)
    shared = rows.sparkSession.sparkContext.broadcast((tree, found.bounds))
    placed = cut(laid_out(marked, tree).select("_population", "_block", "_unit", "_code", "_score", "_flag"))

    def weighted(batches: Iterator[pa.RecordBatch], parts: Sequence[int]) -> Iterator[pa.RecordBatch]:
        draws = Draws(shared.value[0])
        held: list[tuple] = []
        blocks: list[tuple] = []
        before = 0

        def out() -> Iterator[pa.RecordBatch]:
            code, place, flagged, at = (np.concatenate(x) for x in zip(*held))
            lines = _Rows(code, place, flagged, at, shared.value[1])
            for part in parts:
                yield from lines.sent(np.concatenate([draws.by_unit(seed, name, block, units, part) for name, block, units in blocks]), part, replicates)

        for name, block, table in _blocks(batches):
            at, units = unit_index(table)
            held.append((table.column("_code").to_numpy(), table.column("_score").to_numpy(), table.column("_flag").to_numpy() == 1, at + before))
            blocks.append((name, block, units))
            before += units
            if before >= SENT_UNITS:
                yield from out()
                held, blocks, before = [], [], 0
        if blocks:
            yield from out()

    units = sum(int(sizes[0][0]) for sizes in tree.sizes.values())
    return _together(rows, found, units, replicates, lambda parts: placed.mapInArrow(lambda batches: weighted(batches, parts), _SENT))


def percentile_intervals(replicates: DataFrame, statistics: Sequence[str], keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """(keys, statistic, valid_replicates, lower, upper), over ``replicates`` numbers each."""
    long = replicates.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("_v")) for c in statistics])).alias("s")).select(*keys, "s.*")
    return long.groupBy(*keys, "statistic").agg(F.count("_v").alias("valid_replicates"), F.percentile("_v", N(0.025)).alias("lower"), F.percentile("_v", N(0.975)).alias("upper"))


def drawn_statistics(rows: DataFrame, flag: str, score: str, replicates: int, seed: int, keys: Sequence[str] = ("endpoint",), unit: str = UNIT) -> DataFrame:
    """AUROC and average precision of every replicate as in :func:`replicate_statistics`, with the draws of :func:`resample.draw_counts`:
    draw ``j`` of a replicate is the unit at a digest's position among the units of the key."""
    spark, width = rows.sparkSession, B.RANGE
    found = _Order(rows, flag, score, keys, unit)
    indexed = positions(rows.select(*keys, unit).distinct(), [unit], keys).select(*keys, unit, "pos", "group_rows")
    groups = indexed.groupBy(*keys).agg(F.max("group_rows").alias("n")).orderBy("n", *keys).collect()  # one line per key
    seats, sizes = B._seated(groups, keys, {f.name: f.dataType.simpleString() for f in indexed.schema}, spark)
    placed = found.dealt.join(indexed, [*keys, unit]).join(seats, list(keys)).select(
        "size", "lane", F.floor(F.col("pos") / width).cast("int").alias("range"), (F.col("pos") % width).cast("int").alias("at"), "_code", "_score", "_flag")

    def pack(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).select(["size", "lane", "range"])
        for c in ("at", "_code", "_score", "_flag"):
            one = one.append_column(c, pa.array([table.column(c).to_numpy().tobytes()], pa.binary()))
        return one

    blocks = cut(placed.groupBy("size", "lane", "range").applyInArrow(pack, "size bigint, lane int, range int, at binary, _code binary, _score binary, _flag binary"))
    shared = spark.sparkContext.broadcast(found.bounds)

    def weighted(counted: pa.Table, copies: pa.Table) -> pa.Table:
        if not (len(counted) and len(copies)):
            return _SENT_KINDS.empty_table()
        size, at, part = (counted.column(c)[0].as_py() for c in ("size", "range", "part"))
        at_unit, code, place, flagged = (np.frombuffer(copies.column(c)[0].as_py(), kind) for c, kind in (("at", np.int32), ("_code", np.int32), ("_score", np.float64), ("_flag", np.int32)))
        times = np.zeros((SLICE, min(width, size - at * width)), np.uint32 if len(counted) > SLICE else np.uint8)
        for replicate, blob in zip(counted.column("replicate").to_pylist(), counted.column("counts").to_pylist()):
            here = B._unpacked(blob, times.shape[1])
            if here.dtype.itemsize > times.dtype.itemsize:
                times = times.astype(np.uint32)
            times[replicate % SLICE] += here.astype(times.dtype)
        lines = _Rows(code, place, flagged == 1, at_unit, shared.value)
        return pa.Table.from_batches(lines.sent(np.ascontiguousarray(times.T), part, replicates), _SENT_KINDS)

    def lines_of(parts: Sequence[int]) -> DataFrame:
        counted = B.draw_counts(sizes, min(replicates, (parts[-1] + 1) * SLICE), [seed], parts[0] * SLICE, SLICE)
        copies = blocks.withColumn("seed", F.lit(seed).cast(B._seed_type([seed]))).withColumn("part", F.explode(F.array(*map(F.lit, parts))))
        return counted.groupBy(*B.BY_RANGE).cogroup(copies.groupBy(*B.BY_RANGE)).applyInArrow(weighted, _SENT)

    return _together(rows, found, max((g["n"] for g in groups), default=0) * SENT_UNITS // width, replicates, lines_of)


def cluster_intervals(rows: DataFrame, flag: str, score: str, statistic: str, replicates: int, seed: int, keys: Sequence[str] = ("endpoint",), unit: str = UNIT) -> DataFrame:
    """(keys, valid_replicates, lower, upper, units, requested_replicates): what :func:`resample.cluster_bootstrap` gives for one of RANKING,
    without a copy of the rows for every replicate."""
    units = rows.select(*keys, unit).distinct().groupBy(*keys).agg(F.count("*").alias("units"))
    found = percentile_intervals(drawn_statistics(rows, flag, score, replicates, seed, keys, unit), [statistic], keys).drop("statistic")
    return units.join(found, list(keys), "left").select(*keys, "valid_replicates", "lower", "upper", "units", F.lit(replicates).alias("requested_replicates"))
