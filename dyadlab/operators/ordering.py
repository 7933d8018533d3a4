"""Ranks, running sums and exact quantiles over groups of any size.

A plain window over a group puts the whole group in one task. Here rows are range-partitioned on (group, order keys),
so a group that holds a third of the table is spread over a third of the partitions; positions are the row number
inside the partition plus the rows before it. Only one line per (partition, group) is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlab.session import cut

PART = "_part"
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits, the row number below

Order = str | Column


def positions(df: DataFrame, order: Sequence[Order], groups: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Add ``pos`` (0-based within the group, in ``order``), ``group_rows`` and the partition number.

    ``order`` should end in a unique key, both for a deterministic result and so that one repeated value can be
    split over partitions. The sorted rows are checkpointed: sampled range bounds must not be drawn twice.
    Unless ``partitions`` is given, up to ``spark.sql.shuffle.partitions`` ranges are made and adaptive execution
    merges neighbours that are small.
    """
    keys = [*groups, *order]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged = cut(spread.sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()))
    local = ranged.withColumns({
        PART: F.shiftright("_row", _ROW_BITS).cast("int"),
        "_row": F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    })
    pieces = local.groupBy(*groups, PART).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    by_part = Window.partitionBy(*groups).orderBy(PART)
    offsets = pieces.select(
        *groups, PART, "_first",
        F.coalesce(F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("group_rows"),
    )
    # at most (partitions + groups) lines
    return (
        local.join(F.broadcast(offsets), [*groups, PART])
        .withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before"))
        .drop("_row", "_first", "_before")
    )


def running_sums(ordered: DataFrame, sums: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums over the output of :func:`positions`, partition by partition plus carried totals."""
    inside = Window.partitionBy(*groups, PART).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = ordered.groupBy(*groups, PART).agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        *groups, PART,
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_carry_{name}") for name in sums],
    )
    return (
        ordered.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
        .join(F.broadcast(carried), [*groups, PART])
        .withColumns({name: F.col(name) + F.col(f"_carry_{name}") for name in sums})
        .drop(*[f"_carry_{name}" for name in sums])
    )


def quantiles_of(ordered: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles read off the positions; only the bracketing rows are shuffled."""
    picks, touched = [], F.lit(False)
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("group_rows") - 1)
        low = F.floor(spot)
        high = F.least(low + 1, F.col("group_rows") - 1)
        touched = touched | (F.col("pos") == low) | (F.col("pos") == high)
        at_low = F.max(F.when(F.col("pos") == low, F.col(value)))
        at_high = F.max(F.when(F.col("pos") == high, F.col(value)))
        picks.append((at_low + (at_high - at_low) * F.max(spot - low)).alias(name))
    return ordered.filter(touched).groupBy(*groups).agg(*picks)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of one numeric column per group; nulls and NaN are left out.

    With ``ties`` (a unique key) rows are sorted as they are. Without, equal values are folded to one line with a
    count first, so a value shared by a third of the rows costs one line, not one task.
    """
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if ties:
        return quantiles_of(positions(kept.select(*groups, value, *ties), [value, *ties], groups), value, probs, groups)
    folded = kept.groupBy(*groups, value).agg(F.count("*").alias("_times"))
    lines = positions(folded, [value], groups)
    ordered = running_sums(lines, {"_upto": F.col("_times")}, groups)
    sizes = lines.groupBy(*groups).agg(F.sum("_times").alias("_n"))
    if groups:
        placed = ordered.join(F.broadcast(sizes), list(groups))  # one line per group
    else:
        placed = ordered.withColumn("_n", sizes.scalar())
    picks, touched = [], F.lit(False)
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(spot)
        high = F.least(low + 1, F.col("_n") - 1)
        covers = lambda at: (at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_times"))
        touched = touched | covers(low) | covers(high)
        at_low, at_high = F.max(F.when(covers(low), F.col(value))), F.max(F.when(covers(high), F.col(value)))
        picks.append((at_low + (at_high - at_low) * F.max(spot - low)).alias(name))
    return placed.filter(touched).groupBy(*groups).agg(*picks)


def hash_rank(df: DataFrame, digest: str, groups: Sequence[str] = (), ties: Sequence[Order] = (), out: str = "rank") -> DataFrame:
    """1-based rank inside each group by a hex digest.

    Digests are uniform, so their first three digits split any group, however large, into 4,096 even buckets; ranks
    are bucket-local row numbers plus the rows in earlier buckets (at most 4,096 lines per group).
    """
    bucketed = df.withColumn("_bucket", F.substring(digest, 1, 3))
    keys = [*groups, "_bucket"]
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys).orderBy(digest, *ties)
    return (
        bucketed.withColumn(out, F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """One line per distinct (group, value) with its count and its average rank (ties share the mean rank)."""
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("ties"))
    ranked = running_sums(positions(counted, [value], groups), {"_upto": F.col("ties")}, groups)
    return ranked.select(
        *groups, value, "ties", (F.col("_upto") - (F.col("ties") - 1) / F.lit(2.0)).cast("double").alias(out)
    )


def hash_cuts(df: DataFrame, digest: str, targets: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    """Digest of the k-th row of each group in digest order, for every ``(groups, label, k)`` line of ``targets``.

    Comparing a row's digest with its cut replaces ranking all rows: only the one bucket in 4,096 that holds the
    k-th row is sorted. A target of zero has no cut.
    """
    bucketed = df.select(*groups, digest, F.substring(digest, 1, 3).alias("_bucket"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    wanted = counts.join(targets.filter("k > 0"), list(groups)).filter("_before < k AND k <= _before + _n").select(
        *groups, label, "_bucket", (F.col("k") - F.col("_before")).alias("_nth"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(digest)
    # a line per group and label: the rows are filtered where they are, not shuffled
    near = bucketed.join(F.broadcast(wanted.select(*groups, "_bucket").distinct()), [*groups, "_bucket"], "left_semi")
    ranked = near.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(F.broadcast(wanted), [*groups, "_bucket"]).filter("_rank = _nth").select(*groups, label, F.col(digest).alias("cut"))
