"""Clean-pair cohort, stratified holdout, folds and balance tables. Randomness is a keyed digest of the unit id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.ordering import exact_quantiles, hash_cuts, hash_rank
from dyadlab.operators.pairs import SIDE, UNIT, pair_wide
from dyadlab.session import cut

N = S.number
DEVELOPMENT, HOLDOUT = "development", "final_holdout"


def clean_pairs(rows: DataFrame, labels: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Units with exactly two rows, one per side, and every label binary on both; one wide line each."""
    binary = F.lit(True)
    for c in labels:
        binary = binary & S.in_domain(F.col(c), (0, 1))
    wide = pair_wide(rows.withColumn("_binary", binary.cast("int")), [*dict.fromkeys([*labels, *values]), "_binary"])
    return wide.filter("_binary_r = 1 AND _binary_l = 1").drop("_binary_r", "_binary_l")


def exclusion_counts(rows: DataFrame, labels: Sequence[str], quality: str, device: str) -> DataFrame:
    """Cohort accounting; the exclusion counts overlap."""
    binary = F.lit(True)
    for c in labels:
        binary = binary & S.in_domain(F.col(c), (0, 1))
    side = F.col(SIDE)
    units = rows.groupBy(UNIT).agg(
        F.count("*").alias("n"), F.count_if(side == 1).alias("r"), F.count_if(side == 2).alias("l"), F.count_if(binary).alias("b"),
        F.min(side).alias("lo"), F.max(side).alias("hi"), F.count_if(~S.in_domain(F.col(quality), (1, 2))).alias("q"),
        F.min(device).alias("d0"), F.max(device).alias("d1"), F.size(F.collect_set(side)).alias("sides"))
    clean = (F.col("n") == 2) & (F.col("r") == 1) & (F.col("l") == 1) & (F.col("b") == 2)
    return units.agg(
        F.sum("n").alias("all_rows"), F.count("*").alias("all_units"), F.count_if(clean).alias("clean_units"), F.count_if(~clean).alias("other_units"),
        F.count_if(F.col("n") == 1).alias("single_row"), F.count_if(F.col("lo") == F.col("hi")).alias("single_side"),
        F.count_if(F.col("sides") < F.col("n")).alias("duplicate_side"), F.count_if(F.col("n") > 2).alias("over_two_rows"),
        F.count_if(F.col("d0") != F.col("d1")).alias("several_devices"), F.sum("q").alias("invalid_quality_rows"))


# -- apportionment -----------------------------------------------------------------------------------------------


def hamilton(counts: DataFrame, key: str, target: Column, parents: Sequence[str] = (), n: str = "n", out: str = "quota") -> DataFrame:
    """Largest-remainder apportionment of ``target`` inside each parent over a table of stratum counts.

    Remainders are compared as integers, so no two differ by rounding alone. Ties: smaller stratum, then lower key.
    """
    inside = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    wide = lambda c: c.cast("decimal(19,0)")
    product = wide(F.col(n)) * wide(F.col("_target"))
    shared = counts.withColumns({"_target": target.cast("bigint"), "_total": F.sum(n).over(inside)}).withColumn("_rest", product % wide(F.col("_total")))
    based = shared.withColumn("_base", ((product - F.col("_rest")) / wide(F.col("_total"))).cast("bigint"))
    order = inside.orderBy(F.col("_rest").desc(), F.col(n), F.col(key))
    spare = F.col("_target") - F.sum("_base").over(inside)
    return based.withColumn(out, F.col("_base") + (F.row_number().over(order) <= spare).cast("bigint")).drop("_target", "_total", "_rest", "_base")


def stratum_quotas(units: DataFrame, first: str, second: str, fraction: float) -> DataFrame:
    """Holdout quota of every (first, second) stratum: first-level totals, then second level inside each."""
    cells = units.groupBy(first, second).agg(F.count("*").alias("n"))
    tops = cells.groupBy(first).agg(F.sum("n").alias("n"))
    goal = F.rint(N(fraction) * tops.agg(F.sum("n")).scalar())
    top_quota = hamilton(tops, first, goal, out="_goal").drop("n")
    return hamilton(cells.join(top_quota, first), second, F.col("_goal"), [first]).drop("_goal")


def assign_holdout(units: DataFrame, first: str, second: str, fraction: float, seed: int) -> DataFrame:
    """Each unit's partition: the quota of every stratum goes to its lowest digests."""
    drawn = units.withColumn("digest", S.keyed_digest(seed, F.col(UNIT)))
    quotas = stratum_quotas(units, first, second, fraction)
    targets = quotas.select(first, second, F.lit("holdout").alias("_cut"), F.col("quota").alias("k"))
    cuts = hash_cuts(drawn, "digest", targets, [first, second], "_cut").drop("_cut")
    chosen = F.coalesce(F.col("digest") <= F.col("cut"), F.lit(False))
    # one line per stratum: device pairs x states
    return drawn.join(F.broadcast(cuts), [first, second], "left").withColumn(
        "partition", F.when(chosen, HOLDOUT).otherwise(DEVELOPMENT)).drop("cut", "digest")


def content_hash(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content digest: row count and the exact sum of 60-bit row digests (combines map-side). Unlike rows never
    have the same encoding: separators inside values are escaped, and null is no value."""
    digest = S.digest_int(F.sha2(S.joined_parts(*[F.col(c) for c in columns]), 256), 1)
    return rows.agg(F.count("*").alias("rows"), F.sum(digest.cast("decimal(38,0)")).cast("string").alias("content_hash"))


# -- folds -------------------------------------------------------------------------------------------------------


def _dealt(ranked: DataFrame, stratum: str, folds: int, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Deal ranks round-robin, each stratum starting where the one before it stopped, so folds differ by one unit at most."""
    before = Window.partitionBy(*keys).orderBy(stratum) if keys else Window.partitionBy(F.lit(0)).orderBy(stratum)
    starts = ranked.groupBy(*keys, stratum).agg(F.count("*").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    dealt = ranked.join(starts, [*keys, stratum])
    return dealt.withColumn(out, ((F.col("_start") + F.col("rank") - 1) % folds).cast("int")).drop("_start", "rank", "digest")


def outer_folds(units: DataFrame, stratum: str = "state", folds: int = 5, seed: int = 20260901) -> DataFrame:
    drawn = units.select(UNIT, stratum).withColumn("digest", S.keyed_digest(seed, F.col(UNIT)))
    return _dealt(hash_rank(drawn, "digest", [stratum], [UNIT]), stratum, folds, "outer_fold")


def inner_folds(outer: DataFrame, stratum: str = "state", folds: int = 5, inner: int = 3, seed: int = 20260902) -> DataFrame:
    """Inner folds of every outer training set, all outer folds in one pass: (unit, assessed outer fold, inner fold)."""
    spread = outer.withColumn("assessed", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("assessed <> outer_fold")
    drawn = spread.select(UNIT, stratum, "assessed", F.sha2(F.concat_ws("|", (F.lit(seed) + F.col("assessed")).cast("string"), F.col(UNIT).cast("string")), 256).alias("digest"))
    return _dealt(hash_rank(drawn, "digest", ["assessed", stratum], [UNIT]), stratum, inner, "inner_fold", ["assessed"])


def fold_manifest(units: DataFrame, stratum: str = "state", folds: int = 5, inner: int = 3, outer_seed: int = 20260901, inner_seed: int = 20260902) -> DataFrame:
    """Long manifest: one line per unit and outer fold; the inner fold is null where the unit is assessed."""
    outer = cut(outer_folds(units, stratum, folds, outer_seed))
    inside = inner_folds(outer, stratum, folds, inner, inner_seed)
    grid = outer.withColumn("assessed", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return grid.join(inside.select(UNIT, "assessed", "inner_fold"), [UNIT, "assessed"], "left")


def fold_violations(folds: DataFrame, fold: str, expected: int, stratum: str = "state", states: Sequence[str] = S.STATES) -> DataFrame:
    """Broken fold rules as lines; empty when all hold."""
    per = folds.groupBy(fold).agg(F.sort_array(F.collect_set(stratum)).alias("have"), F.count("*").alias("units"))
    lacking = per.filter(F.size(F.array_except(F.array(*map(F.lit, states)), "have")) > 0).select(
        F.lit("fold lacks a state").alias("rule"), F.col(fold).cast("string").alias("detail"))
    number = per.agg(F.count("*").alias("k")).filter(F.col("k") != expected).select(F.lit("number of folds").alias("rule"), F.col("k").cast("string").alias("detail"))
    twice = folds.groupBy(UNIT).count().filter("count > 1").select(F.lit("unit repeated").alias("rule"), F.col(UNIT).cast("string").alias("detail"))
    return lacking.unionByName(number).unionByName(twice)


# -- balance -----------------------------------------------------------------------------------------------------


def balance_table(units: DataFrame, variables: Sequence[str], allocation: Sequence[str], partition: str = "partition") -> DataFrame:
    """Variable x level x partition counts and fractions, with eight fixed decimals."""
    long = units.select(partition, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])).alias("_v")).select(partition, "_v.*")
    counted = long.groupBy("variable", "level").agg(
        F.count_if(F.col(partition) == DEVELOPMENT).alias("development_n"), F.count_if(F.col(partition) == HOLDOUT).alias("holdout_n"))
    sizes = units.groupBy().agg(F.count_if(F.col(partition) == DEVELOPMENT).alias("d"), F.count_if(F.col(partition) == HOLDOUT).alias("h"))
    d, h = sizes.select("d").scalar(), sizes.select("h").scalar()
    shares = counted.withColumns({"_d": F.col("development_n") / d, "_h": F.col("holdout_n") / h})
    return shares.select(
        "variable", "level", "development_n", S.fixed_decimals(F.col("_d")).alias("development_fraction"), "holdout_n", S.fixed_decimals(F.col("_h")).alias("holdout_fraction"),
        S.fixed_decimals(F.col("_h") - F.col("_d")).alias("difference"),
        F.when(F.col("variable").isin(*allocation), "allocation").otherwise("descriptive_balance_only").alias("role"))


def number_summary(units: DataFrame, value: str, partition: str = "partition") -> DataFrame:
    """Count, mean and median of a unit-level number per partition."""
    units = cut(units.select(partition, value))
    basic = units.groupBy(partition).agg(F.count(value).alias("evaluable"), F.avg(value).alias("mean"))
    return basic.join(exact_quantiles(units, value, {"median": 0.5}, [partition]), partition, "left")


def unrelated_partner(units: DataFrame, stratum: str, values: Sequence[str], seed: int) -> DataFrame:
    """Negative control: each unit gets the values of the next unit of its stratum in digest order (the last gets the
    first's). Ranks are unique, so the join is one to one whatever the size of a stratum."""
    drawn = units.select(UNIT, stratum, *values).withColumn("digest", S.keyed_digest(seed, F.col(UNIT)))
    ranked = hash_rank(drawn, "digest", [stratum], [UNIT]).drop("digest")
    sizes = ranked.groupBy(stratum).agg(F.count("*").alias("_n"))
    seeking = ranked.join(sizes, stratum).withColumn("_next", F.col("rank") % F.col("_n") + 1)
    donors = ranked.select(stratum, F.col("rank").alias("_next"), F.col(UNIT).alias("control_unit"), *[F.col(v).alias(f"control_{v}") for v in values])
    return seeking.join(donors, [stratum, "_next"]).drop("_next", "_n", "rank")
