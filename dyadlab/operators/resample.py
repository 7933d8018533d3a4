"""Bootstrap over units: resampled means, BCa intervals, cluster bootstrap of any grouped statistic.

Draw ``j`` of replicate ``b`` is a digest of (seed, b, j), so a run can be repeated exactly, on any cluster layout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.ordering import positions
from dyadlab.operators.pairs import UNIT
from dyadlab.session import shuffle_width

N = S.number
BROADCAST_ROWS = 1_000_000  # not read any more: tables of all sizes take one path (an existing test sets it)
DRAWS_PER_DIGEST, DIGITS = 4, 15
LANE = 16  # keys of equal size that share their draws
CHUNK = 1 << 20  # digests made from one line
RANGE = 1 << 14  # positions whose counts travel as one line
SLICE = 128  # replicates that meet a copy of a range together
_AT_ONCE = 1 << 15  # digests a task makes at a time
_FEW = 1 << 11  # so few digests are made singly
_CODEC = "zstd"


def _fraction(p: int, root: int) -> int:
    """First 32 bits of the fraction of a root of a small number, by whole numbers."""
    low, high, wanted = 0, p << 32, p << 32 * root
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**root <= wanted else (low, middle - 1)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]  # the first 64
_START, _ROUND = (np.array([_fraction(p, root) for p in _PRIMES[:many]], np.uint32) for root, many in ((2, 8), (3, 64)))


def _turned(x: np.ndarray, by: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    np.right_shift(x, np.uint32(by), out=out)
    np.left_shift(x, np.uint32(32 - by), out=spare)
    return np.bitwise_or(out, spare, out=out)


def _sha256_words(prefix: bytes, first: int, last: int) -> np.ndarray:
    """The eight words of sha256(prefix + number) for the numbers ``first`` to ``last`` - 1, which have equally many digits; the message
    is one block. All numbers take each step of the digest together (1.3 us each with all cores busy, single calls 2.2 us)."""
    size, m = len(prefix) + len(str(first)), last - first
    block = bytearray(64)
    block[: len(prefix)], block[size], block[56:] = prefix, 0x80, (8 * size).to_bytes(8, "big")
    w = [np.full(m, int.from_bytes(block[i : i + 4], "big"), np.uint32) for i in range(0, 64, 4)]
    rest = np.arange(first, last, dtype=np.uint64)
    for at in range(size - 1, len(prefix) - 1, -1):
        rest, digit = np.divmod(rest, np.uint64(10))
        w[at // 4] += (digit.astype(np.uint32) + np.uint32(ord("0"))) << np.uint32(24 - 8 * (at % 4))
    s, t, o = (np.empty(m, np.uint32) for _ in range(3))
    a, b, c, d, e, f, g, h = (np.full(m, x, np.uint32) for x in _START)
    for i in range(64):
        now = w[i % 16]
        if i >= 16:
            for x, one, two, gone in ((w[(i - 15) % 16], 7, 18, 3), (w[(i - 2) % 16], 17, 19, 10)):
                _turned(x, one, s, t)
                s ^= _turned(x, two, o, t)
                s ^= np.right_shift(x, np.uint32(gone), out=o)
                now += s
            now += w[(i - 7) % 16]
        h += now
        h += _ROUND[i]
        np.bitwise_xor(e, _turned(e, 14, s, t), out=s)  # turned by 6, 11 and 25
        np.bitwise_xor(e, _turned(s, 5, o, t), out=o)
        h += _turned(o, 6, s, t)
        np.bitwise_xor(f, g, out=s)  # f where e has a bit, else g
        s &= e
        s ^= g
        h += s
        d += h
        np.bitwise_xor(a, _turned(a, 9, s, t), out=s)  # turned by 2, 13 and 22
        np.bitwise_xor(a, _turned(s, 11, o, t), out=o)
        h += _turned(o, 2, s, t)
        np.bitwise_or(a, b, out=s)  # the bit most of a, b, c have
        s &= c
        s |= np.bitwise_and(a, b, out=o)
        h += s
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return np.stack([x + y for x, y in zip((a, b, c, d, e, f, g, h), _START)], 1)


def _digests(prefix: bytes, first: int, last: int) -> np.ndarray:
    """sha256(prefix + number) as four 64-bit words, for the numbers ``first`` to ``last`` - 1."""
    out, at = [], first
    while at < last:
        end = min(last, at + _AT_ONCE, 10 ** len(str(at)))
        if end - at < _FEW or len(prefix) + len(str(at)) > 55:
            words = np.frombuffer(b"".join([hashlib.sha256(prefix + b"%d" % i).digest() for i in range(at, end)]), ">u4")
        else:
            words = _sha256_words(prefix, at, end)
        pairs = words.reshape(-1, 4, 2).astype(np.uint64)
        out.append(pairs[:, :, 0] << np.uint64(32) | pairs[:, :, 1])
        at = end
    return np.concatenate(out)


def _positions_of(prefix: bytes, first: int, last: int, n: int) -> np.ndarray:
    """Draws of the digests ``first`` to ``last`` - 1: each digest gives four numbers of 15 hex digits, modulo ``n``."""
    out = []
    for a in range(first, last, _AT_ONCE):
        w = _digests(prefix, a, min(a + _AT_ONCE, last))
        bits = [np.uint64(4 * DIGITS * m % 64) for m in range(DRAWS_PER_DIGEST)]  # where the number starts in its 64-bit word
        spare = np.uint64(64 - 4 * DIGITS)
        four = [((w[:, 0] << bits[0]) if m == 0 else (w[:, m - 1] << bits[m]) | (w[:, m] >> (np.uint64(64) - bits[m]))) >> spare for m in range(DRAWS_PER_DIGEST)]
        out.append((np.stack(four, 1) % np.uint64(n)).astype(np.int64).ravel())
    return np.concatenate(out)[: n - DRAWS_PER_DIGEST * first]


def _packed(counts: np.ndarray) -> bytes:
    """Counts with as many bytes each as the largest needs (the first byte says how many), compressed."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + pa.compress(counts.astype(kind).tobytes(), _CODEC, asbytes=True)


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[1:], size * blob[0], _CODEC, asbytes=True), f"<u{blob[0]}")


def draw_counts(sizes: DataFrame, replicates: int, seeds: Sequence[int], first: int = 0, together: int | None = None) -> DataFrame:
    """(size, lane, range, seed, part, replicate, counts): how often each position is drawn, n of n with replacement, for each replicate of
    each ``(size, lane)`` line. Replicates ``first`` to ``replicates`` - 1 are drawn; a part is ``together`` of them (``SLICE``).

    Draws never leave the task that makes them: a line holds the counts of ``RANGE`` positions, some two bits a position. Lines to draw
    are dealt evenly over the tasks, and one stands for ``CHUNK`` digests at most, so neither a replicate nor a key is drawn by a
    single task.
    """
    chunk, width, slice_ = CHUNK, RANGE, together or SLICE
    kind = _seed_type(seeds)
    spread = (
        sizes.select("size", "lane", F.explode(F.array(*[F.lit(int(s)).cast(kind) for s in seeds])).alias("seed"))
        .withColumn("replicate", F.explode(F.sequence(F.lit(first), F.lit(replicates - 1))))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / (chunk * DRAWS_PER_DIGEST)))))
    ).repartition(shuffle_width(sizes.sparkSession))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, lane, seed, replicate, at in zip(*(c.to_pylist() for c in batch.columns)):
                digests = -(-n // DRAWS_PER_DIGEST)
                found = _positions_of(b"%d|%d|" % (seed, replicate), at * chunk, min((at + 1) * chunk, digests), n)
                if 8 * len(found) >= n:  # most positions are drawn
                    times = np.bincount(found, minlength=n)
                    ranges = np.flatnonzero(np.maximum.reduceat(times, np.arange(0, n, width)))
                    counts = [_packed(times[r * width : (r + 1) * width]) for r in ranges.tolist()]
                else:
                    found.sort()
                    ranges = np.unique(found // width)
                    edges = np.searchsorted(found, np.append(ranges, ranges[-1] + 1) * width)
                    counts = [_packed(np.bincount(found[a:b] - r * width, minlength=min(width, n - r * width))) for r, a, b in zip(ranges.tolist(), edges, edges[1:])]
                same = lambda v, t: pa.array([v] * len(ranges), t)
                yield pa.RecordBatch.from_arrays(
                    [same(n, pa.int64()), same(lane, pa.int32()), pa.array(ranges, pa.int32()), same(seed, pa.int32() if kind == "int" else pa.int64()),
                     same(replicate // slice_, pa.int32()), same(replicate, pa.int32()), pa.array(counts, pa.binary())],
                    names=["size", "lane", "range", "seed", "part", "replicate", "counts"])

    return spread.mapInArrow(drawn, f"size bigint, lane int, range int, seed {kind}, part int, replicate int, counts binary")


def _seed_type(seeds: Sequence[int]) -> str:
    return "int" if all(-(1 << 31) <= int(s) < 1 << 31 for s in seeds) else "bigint"


def _seated(groups: Sequence[Row], keys: Sequence[str], types: dict[str, str], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(keys, size, lane, slot): keys of equal size sit side by side, ``LANE`` to a lane; and the (size, lane) lines to draw for."""
    seen: dict[int, int] = {}
    lines = []
    for g in groups:
        i = seen.get(g["n"], 0)
        seen[g["n"]] = i + 1
        lines.append((*[g[k] for k in keys], g["n"], i // LANE, i % LANE))
    seats = spark.createDataFrame(lines, ", ".join(f"{k} {types[k]}" for k in keys) + ", size bigint, lane int, slot int")
    return F.broadcast(seats), spark.createDataFrame(sorted({(x[-3], x[-2]) for x in lines}), "size bigint, lane int")


BY_RANGE = ["size", "lane", "range", "seed", "part"]


def _copies(blocks: DataFrame, replicates: int, seeds: Sequence[int]) -> DataFrame:
    """A line of each block for every seed and slice of replicates (few: a slice is ``SLICE`` replicates)."""
    return blocks.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast(_seed_type(seeds)) for s in seeds]))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // SLICE))))


def bootstrap_means(values: DataFrame, value: str, replicates: int, seeds: Sequence[int], keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Mean of ``value`` in each replicate of each key; sampling n of n units with replacement.

    Keys with the same number of units share their draws (a draw depends on seed, replicate and position only): each draw is hashed
    once for up to ``LANE`` keys. The values of ``RANGE`` positions meet the counts of these positions, ``SLICE`` replicates at a
    time, and a range sends one sum per key and replicate.
    """
    width = RANGE
    indexed = positions(values.select(*keys, UNIT, F.col(value).cast("double").alias("_v")), [UNIT], keys).select(*keys, "pos", "group_rows", "_v")
    types = {f.name: f.dataType.simpleString() for f in indexed.schema}
    groups = indexed.groupBy(*keys).agg(F.max("group_rows").alias("n")).orderBy("n", *keys).collect()  # one line per key
    seats, sizes = _seated(groups, keys, types, values.sparkSession)
    placed = indexed.join(seats, list(keys)).select("size", "lane", F.floor(F.col("pos") / width).cast("int").alias("range"), "slot", (F.col("pos") % width).cast("int").alias("at"), "_v")

    def block(table: pa.Table) -> pa.Table:
        size, lane, at = (table.column(c)[0].as_py() for c in ("size", "lane", "range"))
        slots = table.column("slot").to_numpy()
        column = table.column("_v")
        data = np.full((int(slots.max()) + 1, min(width, size - at * width)), np.nan)
        there = np.zeros(data.shape, bool)  # a null has no part in a mean; NaN and infinities have
        where = slots, table.column("at").to_numpy()
        data[where], there[where] = column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy()
        return pa.table({"size": [size], "lane": pa.array([lane], pa.int32()), "range": pa.array([at], pa.int32()), "slots": pa.array([len(data)], pa.int32()),
                         "data": pa.array([data.tobytes()], pa.binary()), "there": pa.array([there.tobytes()], pa.binary())})

    blocks = placed.groupBy("size", "lane", "range").applyInArrow(block, "size bigint, lane int, range int, slots int, data binary, there binary")

    def sums(counted: pa.Table, copies: pa.Table) -> pa.Table:
        empty = {c: [] for c in ("replicate", "slot", "total", "times")}
        if len(counted) and len(copies):
            slots = copies.column("slots")[0].as_py()
            data = np.frombuffer(copies.column("data")[0].as_py()).reshape(slots, -1)
            there = np.frombuffer(copies.column("there")[0].as_py(), bool).reshape(slots, -1)
            plain = there & np.isfinite(data)
            design = np.concatenate([np.where(plain, data, 0.0), there.astype(float)]).T
            odd = [np.flatnonzero(row) for row in there & ~plain]
            for replicate, blob in zip(counted.column("replicate").to_pylist(), counted.column("counts").to_pylist()):
                times = _unpacked(blob, data.shape[1])
                both = times.astype(float) @ design
                for slot in range(slots):
                    drawn = odd[slot][times[odd[slot]] > 0]
                    empty["replicate"].append(replicate)
                    empty["slot"].append(slot)
                    empty["total"].append(both[slot] + data[slot, drawn].sum())
                    empty["times"].append(both[slots + slot])
        rows = len(empty["slot"])
        same = lambda c: pa.array([counted.column(c)[0].as_py()] * rows if rows else [], counted.schema.field(c).type)
        return pa.table({"size": same("size"), "lane": same("lane"), "seed": same("seed"), "replicate": pa.array(empty["replicate"], pa.int32()),
                         "slot": pa.array(empty["slot"], pa.int32()), "total": pa.array(empty["total"], pa.float64()), "times": pa.array(empty["times"], pa.float64())})

    partial = draw_counts(sizes, replicates, seeds).groupBy(*BY_RANGE).cogroup(_copies(blocks, replicates, seeds).groupBy(*BY_RANGE)).applyInArrow(
        sums, f"size bigint, lane int, seed {_seed_type(seeds)}, replicate int, slot int, total double, times double")
    mean = F.when(F.sum("times") > 0, F.sum("total") / F.sum("times"))
    return partial.join(seats, ["size", "lane", "slot"]).groupBy(*keys, "seed", "replicate").agg(mean.alias("mean"))


def diagnostics(values: DataFrame, means: DataFrame, value: str, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Per key and seed: estimate, spread of the replicates, half-tie fraction below the estimate, acceleration.

    The jackknife acceleration of a mean is its population skewness over 6 sqrt(n); no unit is left out in turn.
    """
    base = values.groupBy(*keys).agg(
        F.count(value).alias("units"), F.avg(value).alias("estimate"), (F.max(value) - F.min(value)).alias("value_range"),
        (F.skewness(value) / (N(6) * F.sqrt(F.count(value)))).alias("acceleration"))
    total = F.count("*")
    low = F.count_if(F.col("mean") < F.col("estimate")) + N(0.5) * F.count_if(F.col("mean") == F.col("estimate"))
    clip = N(0.5) / total
    joined = means.join(base.select(*keys, "estimate"), list(keys))
    spread = joined.groupBy(*keys, "seed").agg(
        total.alias("replicates"), F.avg("mean").alias("replicate_mean"), F.stddev_samp("mean").alias("replicate_sd"), F.min("mean").alias("replicate_min"),
        F.max("mean").alias("replicate_max"), F.greatest(clip, F.least(N(1) - clip, low / total)).alias("fraction_less"))
    return spread.join(base, list(keys)).withColumn("bias", F.col("replicate_mean") - F.col("estimate"))


def _adjusted(fraction_less: float, acceleration: float, alpha: float) -> float:
    normal = NormalDist()
    z0 = normal.inv_cdf(fraction_less)
    shifted = z0 + normal.inv_cdf(alpha)
    return min(1.0, max(0.0, normal.cdf(z0 + shifted / (1.0 - acceleration * shifted))))


def bca_interval(
    values: DataFrame, value: str, replicates: int, seeds: Sequence[int], keys: Sequence[str] = ("endpoint",),
    alphas: tuple[float, float] = (0.025, 0.975), resample: Callable[[DataFrame, str, int, Sequence[int], Sequence[str]], DataFrame] = bootstrap_means,
) -> DataFrame:
    """Bias-corrected accelerated interval per key and seed. ``resample`` gives the means of the replicates.

    Fewer than two units, or no finite value: not estimable. No spread at all: a point mass that never counts as significant.
    Only one line per key and seed reaches the driver, to place the two quantiles.
    """
    x = F.col(value)
    finite = values.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < N(float("inf"))))
    means = resample(finite, value, replicates, seeds, keys)
    from dyadlab.session import cut

    means = cut(means)
    stats = diagnostics(finite, means, value, keys)
    spark = values.sparkSession
    lines = []
    for row in stats.collect():
        usable = row["units"] >= 2 and row["value_range"] > 0
        a = row["acceleration"] if usable else 0.0
        low, high = (_adjusted(row["fraction_less"], a, alpha) for alpha in alphas) if usable else (None, None)
        z0 = NormalDist().inv_cdf(row["fraction_less"]) if usable else None
        method = "BCa" if usable else "not_estimable" if row["units"] < 2 else "percentile_point_mass_fallback"
        lines.append((*[row[k] for k in keys], row["seed"], z0, low, high, method))
    types = {f.name: f.dataType.simpleString() for f in stats.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "seed"]) + ", z0 double, p_low double, p_high double, method string"
    placed = spark.createDataFrame(lines, schema)
    sorted_means = means.groupBy(*keys, "seed").agg(F.sort_array(F.collect_list("mean")).alias("_m"))  # `replicates` numbers

    def at(p: Column) -> Column:
        spot = p * (F.size("_m") - 1)
        i = F.floor(spot).cast("int")
        low, high = F.get("_m", i), F.get("_m", F.least(i + 1, F.size("_m") - 1))
        return low + (high - low) * (spot - i)

    estimable, point = F.col("method") != "not_estimable", F.col("method") == "percentile_point_mass_fallback"
    bound = lambda p: F.when(point, F.col("estimate")).when(estimable, at(F.col(p)))
    out = stats.join(placed, [*keys, "seed"]).join(sorted_means, [*keys, "seed"]).select(
        *keys, "seed", "units", "replicates", "estimate", bound("p_low").alias("lower"), bound("p_high").alias("upper"),
        "method", "z0", "acceleration", (F.col("method") == "BCa").alias("significance_eligible"))
    # keys of the input without any finite value
    given = {"seed": F.col("seed"), "units": F.lit(0), "method": F.lit("not_estimable"), "significance_eligible": F.lit(False)}
    empty = values.select(*keys).distinct().join(finite.select(*keys).distinct(), list(keys), "left_anti").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return out.unionByName(empty.select(*[(F.col(c) if c in keys else given.get(c, F.lit(None))).cast(out.schema[c].dataType).alias(c) for c in out.columns]))


def one_sided_lower(values: DataFrame, value: str, replicates: int, seed: int, alpha: float = 0.05, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    return bca_interval(values, value, replicates, [seed], keys, (alpha, 0.999999)).drop("upper")


Statistic = Callable[[DataFrame, Sequence[str]], DataFrame]


def _unit_counts(indexed: DataFrame, replicates: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """(keys, unit, part, times): per unit and slice of replicates, how often it is drawn in each of them."""
    width, slice_ = RANGE, SLICE
    types = {f.name: f.dataType.simpleString() for f in indexed.schema}
    groups = indexed.groupBy(*keys).agg(F.max("group_rows").alias("n")).orderBy("n", *keys).collect()  # one line per key
    seats, sizes = _seated(groups, keys, types, indexed.sparkSession)
    units = indexed.join(seats, list(keys)).select("size", "lane", F.floor(F.col("pos") / width).cast("int").alias("range"), (F.col("pos") % width).cast("int").alias("at"), *keys, UNIT)

    def counts(counted: pa.Table, copies: pa.Table) -> pa.Table:
        kept = copies.select([*keys, UNIT, "part"])
        times = np.zeros((len(copies), slice_), np.int32)
        at = copies.column("at").to_numpy()
        for replicate, blob in zip(counted.column("replicate").to_pylist(), counted.column("counts").to_pylist()):
            here = _unpacked(blob, min(width, counted.column("size")[0].as_py() - counted.column("range")[0].as_py() * width))
            times[:, replicate % slice_] += here[at].astype(np.int32)
        spots = pa.array(np.arange(len(copies) + 1, dtype=np.int32) * slice_)
        return kept.append_column("times", pa.ListArray.from_arrays(spots, pa.array(times.ravel())))

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, UNIT]) + ", part int, times array<int>"
    return draw_counts(sizes, replicates, [seed]).groupBy(*BY_RANGE).cogroup(_copies(units, replicates, [seed]).groupBy(*BY_RANGE)).applyInArrow(counts, schema)


def cluster_bootstrap(
    rows: DataFrame, statistic: Statistic, result: str, replicates: int, seed: int, keys: Sequence[str] = ("endpoint",), weight: str | None = None,
) -> DataFrame:
    """Percentile interval of a statistic when whole units are resampled.

    ``statistic(rows, keys)`` is any grouped computation; all replicates are computed in one run, keyed by replicate. With ``weight``, it
    takes the number of times a row stands for from that column, and rows are not copied.
    A replicate whose statistic is null or not finite is dropped and counted.
    """
    times = weight or "_times"
    units = rows.select(*keys, UNIT).distinct()
    indexed = positions(units, [UNIT], keys).select(*keys, UNIT, "pos", "group_rows")
    sizes = indexed.groupBy(*keys).agg(F.max("group_rows").alias("n"))
    counts = _unit_counts(indexed, replicates, seed, keys)
    # counts are far larger than the packed lines they are made of, so they are never to be broadcast
    drawn = rows.join(counts.hint("merge"), [*keys, UNIT]).select(*rows.columns, "part", F.posexplode("times").alias("_i", times)).filter(F.col(times) > 0)
    resampled = drawn.withColumn("replicate", F.col("part") * SLICE + F.col("_i")).drop("part", "_i")
    if not weight:
        resampled = resampled.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(times)))).drop("_copy", times)
    values = statistic(resampled, [*keys, "replicate"]).select(*keys, "replicate", F.col(result).alias("_v"))
    good = values.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    interval = good.groupBy(*keys).agg(
        F.count("*").alias("valid_replicates"), F.percentile("_v", N(0.025)).alias("lower"), F.percentile("_v", N(0.975)).alias("upper"))  # over `replicates` numbers
    estimate = statistic(rows.withColumn(weight, F.lit(1)) if weight else rows, list(keys)).select(*keys, F.col(result).alias("estimate"))
    return estimate.join(interval, list(keys), "left").join(sizes.withColumnRenamed("n", "units"), list(keys)).withColumn("requested_replicates", F.lit(replicates))


def reproduction_check(now: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-14) -> DataFrame:
    """Largest absolute difference per key between recomputed and stored results."""
    both = now.select(*keys, *columns).join(stored.select(*keys, *[F.col(c).alias(f"_was_{c}") for c in columns]), list(keys), "full_outer")
    gaps = [F.abs(F.col(c) - F.col(f"_was_{c}")) for c in columns]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull() & F.col(f"_was_{c}").isNotNull()
    return both.select(*keys, worst.alias("max_abs_difference"), (complete & (worst < N(tolerance))).alias("reproduced"))
