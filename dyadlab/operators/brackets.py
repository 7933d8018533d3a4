"""Exact quantiles of many overlapping subsets at once, by counting passes that narrow a bracket around every wanted rank.

A pass counts how many values of each subset fall into each of CELLS cells of each bracket, and keeps the cells that hold the wanted
ranks. Cells divide the order of the doubles themselves (their bit patterns), so a pass gains eight bits whatever the spread
of the values, and eight passes end it at worst. Once brackets hold few values, or one value only, what is left is gathered and
sorted. No subset is copied or sorted as a whole, however many subsets a row belongs to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.operators.sums import Columns, batch_columns, grouped_sums

CELLS = 256
FEW = 512  # values of a bracket that are gathered and sorted
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1
Subsets = Callable[[Columns], dict[int, np.ndarray]]


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles (-0.0 as 0.0)."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(_HIGHEST), bits)


def doubles(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, np.int64)
    return np.where(bits < 0, bits ^ np.int64(_HIGHEST), bits).view(np.float64)


def _edges(low: int, high: int) -> np.ndarray:
    """Lower ends of at most CELLS even cells of [low, high]."""
    step = -(-(high - low + 1) // CELLS)
    return np.array(range(low, high + 1, step), np.int64)


class _Rank:
    """The bracket [low, high] around the value of one 0-based rank of a subset."""

    def __init__(self, rank: int, count: int):
        self.rank, self.low, self.high, self.below, self.inside = rank, _LOWEST, _HIGHEST, 0, count

    @property
    def bracket(self) -> tuple[int, int]:
        return self.low, self.high

    @property
    def settled(self) -> bool:
        return self.inside <= FEW or self.low == self.high

    def narrow(self, edges: np.ndarray, counts: np.ndarray) -> None:
        upto = self.below + np.cumsum(counts)
        i = int(np.searchsorted(upto, self.rank, "right"))
        self.below, self.inside = int(upto[i] - counts[i]), int(counts[i])
        self.low, self.high = int(edges[i]), self.high if i + 1 == len(edges) else int(edges[i + 1]) - 1


def subset_quantiles(df: DataFrame, subsets: Subsets, probs: Sequence[float]) -> dict[int, np.ndarray]:
    """Linear-interpolation quantiles of every subset; ``subsets(batch)`` gives the values that a batch adds to each.

    NaN is left out; infinite values are the largest and smallest. A subset without values has no entry. Passes read
    ``df`` again, so store it before. The driver sees CELLS numbers per subset and bracket in a pass and FEW values per bracket
    at the end; a bracket of one repeated value is not gathered.
    """

    def numbers(c: Columns) -> dict[int, np.ndarray]:
        return {k: ordered_bits(v[~np.isnan(v)]) for k, v in subsets(c).items()}

    sizes = {k: int(v[0]) for k, v in grouped_sums(df, lambda c: {k: np.array([float(len(v))]) for k, v in numbers(c).items() if len(v)}).items()}
    ranks: dict[int, dict[int, _Rank]] = {}
    for k, n in sizes.items():
        wanted = {r for p in probs for r in (int(np.floor(p * (n - 1))), min(int(np.floor(p * (n - 1))) + 1, n - 1))}
        ranks[k] = {r: _Rank(r, n) for r in sorted(wanted)}
    while True:
        open_ = {k: {r.bracket: _edges(*r.bracket) for r in of.values() if not r.settled} for k, of in ranks.items()}
        if not any(open_.values()):
            break

        def counts(c: Columns, open_=open_) -> dict[int, np.ndarray]:
            out = {}
            for k, v in numbers(c).items():
                found = []
                for (low, high), edges in open_.get(k, {}).items():
                    mine = v[(v >= low) & (v <= high)]
                    found.append(np.bincount(np.searchsorted(edges, mine, "right") - 1, minlength=len(edges)))
                if found:
                    out[k] = np.concatenate(found).astype(np.float64)
            return out

        for k, v in grouped_sums(df, counts).items():
            ends = np.cumsum([len(e) for e in open_[k].values()])
            found = dict(zip(open_[k], np.split(v.astype(np.int64), ends[:-1])))
            for r in ranks[k].values():
                if not r.settled:
                    bracket = r.bracket
                    r.narrow(open_[k][bracket], found[bracket])
    left = {k: sorted({r.bracket for r in of.values() if r.low != r.high}) for k, of in ranks.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in numbers(batch_columns(batch)).items() if batch.num_rows else ():
                for i, (low, high) in enumerate(left.get(k, ())):
                    value, times = np.unique(v[(v >= low) & (v <= high)], return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(np.full(len(value), i, np.int32)), pa.array(value), pa.array(times)], ["subset", "bracket", "value", "times"])

    # at most FEW values a bracket
    lines = df.mapInArrow(gather, "subset int, bracket int, value long, times long").groupBy("subset", "bracket", "value").agg(F.sum("times").alias("times")).toArrow() if any(left.values()) else None
    held: dict[tuple[int, tuple[int, int]], np.ndarray] = {}
    if lines is not None:
        subset, bracket, value, times = (lines[c].to_numpy() for c in ("subset", "bracket", "value", "times"))
        order = np.lexsort([value, bracket, subset])
        for k, of in left.items():
            for i, b in enumerate(of):
                mine = order[(subset[order] == k) & (bracket[order] == i)]
                held[k, b] = np.repeat(value[mine], times[mine])
    out = {}
    for k, n in sizes.items():
        at = {rank: float(doubles(np.array([r.low if r.low == r.high else held[k, r.bracket][rank - r.below]]))[0]) for rank, r in ranks[k].items()}
        spots = [p * (n - 1) for p in probs]
        low = np.array([at[int(np.floor(s))] for s in spots])
        high = np.array([at[min(int(np.floor(s)) + 1, n - 1)] for s in spots])
        share = np.array(spots) - np.floor(spots)
        out[k] = np.where(share > 0, low + (high - low) * share, low)
    return out
