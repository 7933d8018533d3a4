"""Bootstrap of units by a keyed binomial tree: weights are made where the units sit, so no draw is joined or shuffled.

Units lie in blocks by the leading bits of their hash. The n draws of a replicate are split down a binary tree over the
blocks by binomials, and inside a block by one multinomial. Every random number is keyed by (seed, population, node, slice of
replicates), hence the weights depend on the units alone: not on partitions, tasks, other columns or how many replicates follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dyadlab.operators.pairs import UNIT
from dyadlab.session import dealt

SLICE = 500  # replicates drawn together
BLOCK_UNITS = 1024  # units a block holds on average, until there are 2^MOST_LEVELS blocks
MOST_LEVELS = 16  # so that the block sizes of a population are 65,536 numbers at most
_AT_ONCE = 50  # replicates whose picks are held at a time
_SEPARATOR = "\x1f"


def _generator(*key) -> np.random.Generator:
    digest = hashlib.blake2b(_SEPARATOR.join(map(str, key)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def _name(populations: Sequence[str]) -> Column:
    """One string for the population of a line (length-prefixed parts, so different ones never meet)."""
    parts = [F.coalesce(F.concat(F.length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")), F.lit("-")) for p in populations]
    return F.concat_ws(_SEPARATOR, *parts) if parts else F.lit("")


class Tree:
    """Block sizes of each population, as sums over every subtree; the same on driver and tasks."""

    def __init__(self, leaves: dict[str, dict[int, int]]):
        self.sizes: dict[str, list[np.ndarray]] = {}
        for name, counts in leaves.items():
            n = sum(counts.values())
            levels = min(MOST_LEVELS, max(0, -(-n // BLOCK_UNITS) - 1).bit_length())
            leaf = np.zeros(1 << levels, np.int64)
            for i, c in counts.items():
                leaf[i >> (MOST_LEVELS - levels)] += c
            sums = [leaf]
            while len(sums[-1]) > 1:
                sums.append(sums[-1].reshape(-1, 2).sum(1))
            self.sizes[name] = sums[::-1]

    def depth(self, name: str) -> int:
        return len(self.sizes[name]) - 1


class Draws:
    """Weights of the units of one block in one slice of replicates."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.memory: dict[tuple, np.ndarray] = {}

    def totals(self, seed: int, name: str, level: int, node: int, part: int) -> np.ndarray:
        """How many draws each replicate of slice ``part`` spends below a node."""
        sizes = self.tree.sizes[name]
        if level == 0:
            return np.full(SLICE, sizes[0][0], np.int64)
        where = seed, name, level, node >> 1, part
        left = self.memory.get(where)
        above = self.totals(seed, name, level - 1, node >> 1, part)
        if left is None:
            a, b = sizes[level][(node >> 1) * 2 : (node >> 1) * 2 + 2]
            left = _generator(seed, name, "split", level, node >> 1, part).binomial(above, a / (a + b) if a + b else 0.0)
            if len(self.memory) > 4096:
                self.memory.clear()
            self.memory[where] = left
        return above - left if node & 1 else left

    def weights(self, seed: int, name: str, block: int, units: int, part: int) -> np.ndarray:
        """SLICE x units; units are those of the block, in order of their ids."""
        total = self.totals(seed, name, self.tree.depth(name), block, part)
        picks = _generator(seed, name, "block", block, part).integers(0, units, int(total.sum()))
        at = np.repeat(np.arange(SLICE) * units, total) + picks
        return np.bincount(at, minlength=SLICE * units).reshape(SLICE, units)

    def by_unit(self, seed: int, name: str, block: int, units: int, part: int) -> np.ndarray:
        """The same weights, units x SLICE, as bytes (more only where a weight needs it); drawn for some replicates at a time."""
        total = self.totals(seed, name, self.tree.depth(name), block, part)
        generator = _generator(seed, name, "block", block, part)
        out = np.empty((units, SLICE), np.uint8)
        for first in range(0, SLICE, _AT_ONCE):
            of = total[first : first + _AT_ONCE]
            at = generator.integers(0, units, int(of.sum()))
            at *= len(of)
            at += np.repeat(np.arange(len(of)), of)
            counts = np.bincount(at, minlength=len(of) * units).reshape(units, len(of))
            if out.dtype == np.uint8 and counts.max(initial=0) > 255:
                out = out.astype(np.uint32)
            out[:, first : first + len(of)] = counts
        return out


def grow(rows: DataFrame, populations: Sequence[str], unit: str = UNIT) -> tuple[DataFrame, Tree]:
    """``rows`` with _population, _unit and _leaf, and the tree of their units. What reaches the driver is a number per population and block
    (65,536 blocks at most); populations are strata, not data."""
    named = rows.withColumns({"_population": _name(populations), "_unit": F.col(unit).cast("string")})
    marked = named.withColumn("_leaf", F.shiftrightunsigned(F.xxhash64("_unit"), 64 - MOST_LEVELS).cast("int"))
    counted = marked.select("_population", "_leaf", "_unit").distinct().groupBy("_population", "_leaf").count().toArrow()
    leaves: dict[str, dict[int, int]] = {}
    for name, leaf, n in zip(*(counted[c].to_pylist() for c in ("_population", "_leaf", "count"))):
        leaves.setdefault(name, {})[leaf] = n
    return marked, Tree(leaves)


Block = tuple[str, int, pa.Table]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The rows of each (population, block) of a sorted stream; only one block is held at a time."""
    held: list[pa.RecordBatch] = []
    at: tuple[str, int] | None = None
    for batch in batches:
        names, blocks = batch.column("_population").to_pylist(), batch.column("_block").to_pylist()
        edges = [i for i in range(1, len(names)) if blocks[i] != blocks[i - 1] or names[i] != names[i - 1]]
        for a, b in zip([0, *edges], [*edges, len(names)]):
            if b == a:
                continue
            key = names[a], blocks[a]
            if at is not None and key != at:
                yield *at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if at is not None:
        yield *at, pa.Table.from_batches(held)


def laid_out(marked: DataFrame, tree: Tree) -> DataFrame:
    """Rows of a block together, in order of the units; blocks of a population are spread over all tasks."""
    depth = F.create_map(*[x for name in tree.sizes for x in (F.lit(name), F.lit(MOST_LEVELS - tree.depth(name)))]) if tree.sizes else None
    block = F.expr("_leaf") if depth is None else F.call_function("shiftright", F.col("_leaf"), F.element_at(depth, F.col("_population")))
    spread = marked.withColumn("_block", block.cast("int"))
    return dealt(spread, "_population", "_block").sortWithinPartitions("_population", "_block", "_unit")


def unit_index(table: pa.Table) -> tuple[np.ndarray, int]:
    """Place of each row's unit among the block's units, and how many there are."""
    ids = table.column("_unit").combine_chunks().dictionary_encode()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return ids.indices.to_numpy(), len(ids.dictionary)


def arrow_kinds(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, pa.DataType], str]:
    """Arrow types of some columns, and their part of a schema text (with a comma at its end)."""
    return {c: to_arrow_type(df.schema[c].dataType) for c in columns}, "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def resampled_sums(values: DataFrame, value: str, replicates: int, seeds: Sequence[int], keys: Sequence[str], populations: Sequence[str] = (), unit: str = UNIT, parts: range | None = None) -> DataFrame:
    """(keys, _seed, _part, _sums): per stratum, seed (its place in ``seeds``) and slice, SLICE pairs of doubles: the weighted sum of the
    values and the sum of the weights; of all slices, or of ``parts``. What :func:`resampled_means` says of units and populations holds here."""
    x = F.col(value).cast("double")
    finite = values.filter(F.col(unit).isNotNull() & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    marked, tree = grow(finite.select(*keys, unit, x.alias("_value")), populations, unit)
    parts = range(-(-replicates // SLICE)) if parts is None else parts
    slices = len(parts)
    shared = values.sparkSession.sparkContext.broadcast(tree)
    kinds, lead = arrow_kinds(values, keys)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(shared.value)
        strata: dict[tuple, int] = {}
        total: list[np.ndarray] = []  # per stratum: seed, replicate, (weighted values, weights)
        for name, block, table in _blocks(batches):
            at, units = unit_index(table)
            codes = np.fromiter((strata.setdefault(k, len(strata)) for k in zip(*(table.column(c).to_pylist() for c in keys))), np.int64, len(table))
            total += [np.zeros((len(seeds), slices * SLICE, 2)) for _ in range(len(strata) - len(total))]
            here, local = np.unique(codes, return_inverse=True)
            design = np.zeros((units, len(here), 2))
            np.add.at(design, (at, local, 0), table.column("_value").to_numpy())
            np.add.at(design, (at, local, 1), 1.0)
            for i, seed in enumerate(seeds):
                for j, part in enumerate(parts):
                    got = (draws.weights(seed, name, block, units, part) @ design.reshape(units, -1)).reshape(SLICE, len(here), 2)
                    for k, code in enumerate(here):
                        total[code][i, j * SLICE : (j + 1) * SLICE] += got[:, k]
        for stratum, code in strata.items():
            columns = [pa.array([v] * (len(seeds) * slices), kinds[c]) for c, v in zip(keys, stratum)]
            flat = total[code].reshape(-1, SLICE * 2)
            where = [pa.array(np.repeat(np.arange(len(seeds), dtype=np.int32), slices)), pa.array(np.tile(np.array(parts, np.int32), len(seeds)))]
            yield pa.RecordBatch.from_arrays([*columns, *where, pa.array([r.tobytes() for r in flat], pa.binary())], names=[*keys, "_seed", "_part", "_sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, blob in zip(*(batch.column(c).to_pylist() for c in [*keys, "_seed", "_part", "_sums"])):
                at, mine = tuple(key), np.frombuffer(blob, np.float64)
                found[at] = found[at] + mine if at in found else mine
        for (*stratum, i, part), both in found.items():
            columns = [pa.array([v], kinds[c]) for c, v in zip(keys, stratum)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([both.tobytes()], pa.binary())], names=[*keys, "_seed", "_part", "_sums"])

    schema = f"{lead}_seed int, _part int, _sums binary"
    return laid_out(marked, tree).mapInArrow(sums, schema).repartition(*keys, "_seed", "_part").mapInArrow(added, schema)


def resampled_means(
    values: DataFrame, value: str, replicates: int, seeds: Sequence[int], keys: Sequence[str] = ("endpoint",), populations: Sequence[str] = (), unit: str = UNIT,
) -> DataFrame:
    """(keys, seed, replicate, mean): the weighted mean of each stratum (``keys``) in every replicate.

    ``values`` has one line per stratum and unit. Units, not lines, are resampled, n of the n of each population (all lines with
    equal ``populations``, which must be keys): one weight array per unit serves every stratum that the unit falls in, overlapping
    or not. A stratum without weight in a replicate has no line there. Null units and null or non-finite values are left out.
    A task holds strata x replicates sums, adds up its blocks, and sends these sums only.
    """
    kinds, lead = arrow_kinds(values, keys)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *stratum, i, part, blob in zip(*(batch.column(c).to_pylist() for c in [*keys, "_seed", "_part", "_sums"])):
                both, first = np.frombuffer(blob, np.float64).reshape(SLICE, 2), part * SLICE
                keep = np.flatnonzero((both[:, 1] > 0) & (np.arange(first, first + SLICE) < replicates))
                columns = [pa.array([v] * len(keep), kinds[c]) for c, v in zip(keys, stratum)]
                where = [pa.array(np.full(len(keep), seeds[i], np.int32)), pa.array((first + keep).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *where, pa.array(both[keep, 0] / both[keep, 1])], names=[*keys, "seed", "replicate", "mean"])

    return resampled_sums(values, value, replicates, seeds, keys, populations, unit).mapInArrow(means, f"{lead}seed int, replicate int, mean double")


Resampler = Callable[[DataFrame, str, int, Sequence[int], Sequence[str]], DataFrame]


def within(*populations: str) -> Resampler:
    """A resampler for :func:`dyadlab.operators.resample.bca_interval`: units of each population by themselves."""
    return lambda values, value, replicates, seeds, keys: resampled_means(values, value, replicates, seeds, keys, populations)
