"""Ranking metrics, error detection, calibration error, multiplicity and selection rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.ordering import average_ranks, exact_quantiles, positions, running_sums
from dyadlab.operators.pairs import SIDE, UNIT
from dyadlab.session import cut

N = S.number


# -- ranking -----------------------------------------------------------------------------------------------------


def binary_ranking(rows: DataFrame, label: Column, score: str, keys: Sequence[str] = ("endpoint",), weight: str | None = None) -> DataFrame:
    """AUROC (ties count half) and average precision (step sum) per key; null when a class is absent.

    Equal scores are folded before the sort, so a score shared by many rows is one line. With ``weight``, a row counts that often.
    """
    count = lambda found: F.sum(F.when(found, F.col(weight)).otherwise(0)).cast("bigint") if weight else F.count_if(found)
    folded = rows.groupBy(*keys, F.col(score).alias("_score")).agg(count(label == 1).alias("_p"), count(label == 0).alias("_q"))
    ordered = running_sums(positions(folded, [F.col("_score").desc()], keys), {"_tp": F.col("_p"), "_fp": F.col("_q")}, keys)
    totals = ordered.groupBy(*keys).agg(
        F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"),
        F.sum(F.col("_q").cast("double") * (F.col("_tp") - F.col("_p") / N(2))).alias("_area"),
        F.sum(F.col("_p").cast("double") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_steps"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return totals.select(
        *keys, "positives", "negatives",
        F.when(both, F.col("_area") / (F.col("positives").cast("double") * F.col("negatives"))).alias("auroc"),
        F.when(both, F.col("_steps") / F.col("positives")).alias("average_precision"),
    )


def risk_coverage(rows: DataFrame, error: Column, score: str, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Cumulative error rate when rows are kept in ascending order of predicted loss."""
    ordered = positions(rows.select(*keys, UNIT, SIDE, score, error.cast("int").alias("_e")), [score, UNIT, SIDE], keys)
    return running_sums(ordered, {"errors": F.col("_e")}, keys).select(
        *keys, UNIT, SIDE, (F.col("pos") + 1).alias("retained"), "group_rows", "errors",
        (F.col("errors") / (F.col("pos") + 1)).alias("cumulative_risk"),
    )


def coverage_summary(curve: DataFrame, coverages: Sequence[float] = (0.9, 0.8, 0.7), keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Area under the curve (mean over rows) and the risk at each coverage."""

    def at(c: float) -> Column:
        kept = F.greatest(F.lit(1), F.ceil(N(c) * F.col("group_rows")))
        return F.max(F.when(F.col("retained") == kept, F.col("cumulative_risk"))).alias(f"selective_risk_{round(100 * c)}")

    return curve.groupBy(*keys).agg(F.max("errors").alias("errors"), F.avg("cumulative_risk").alias("aurc"), *[at(c) for c in coverages])


def spearman(rows: DataFrame, observed: str, predicted: Sequence[str], keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Rank correlation of ``observed`` with each prediction, average ranks for ties."""
    columns = [observed, *predicted]
    long = rows.select(*keys, UNIT, SIDE, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in columns
    ])).alias("_v")).select(*keys, UNIT, SIDE, "_v.*")
    by = [*keys, "variable"]
    ranked = long.join(average_ranks(long, "value", by), [*by, "value"])
    wide = ranked.groupBy(*keys, UNIT, SIDE).agg(*[
        F.max(F.when(F.col("variable") == c, F.col("avg_rank"))).alias(f"_rank_{i}") for i, c in enumerate(columns)])
    return wide.groupBy(*keys).agg(*[
        F.corr("_rank_0", f"_rank_{i}").alias(f"spearman_{c.rsplit('_', 1)[-1]}") for i, c in enumerate(columns) if i])


# -- calibration error -------------------------------------------------------------------------------------------


def _binned(rows: DataFrame, edges: DataFrame, bins: int, keys: Sequence[str]) -> DataFrame:
    """All bins of every key with count, mean probability and observed rate; bins are right-closed."""
    inner = F.slice(F.col("edges"), 2, bins - 1)
    slot = F.size(F.filter(inner, lambda e: e < F.col("prob")))
    counts = rows.join(F.broadcast(edges), list(keys)).groupBy(*keys, slot.alias("bin")).agg(
        F.count("*").alias("count"), F.avg("prob").alias("mean_probability"), F.avg(F.col("label").cast("double")).alias("observed_rate"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("count", F.lit(0)).alias("count"),
        F.get("edges", F.col("bin")).alias("lower_edge"), F.get("edges", F.col("bin") + 1).alias("upper_edge"),
        "mean_probability", "observed_rate",
    )


def equal_frequency_edges(rows: DataFrame, bins: int = 10, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    return cut(exact_quantiles(rows, "prob", names, keys).select(*keys, F.array(*names).alias("edges")))  # one line per key, read twice


def reliability_bins(rows: DataFrame, edges: DataFrame, bins: int = 10, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    return _binned(rows, edges, bins, keys)


def calibration_error(bins: DataFrame, min_count: int = 0, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Count-weighted absolute gap. Not estimable, with the reason, on repeated edges or a thin bin."""
    gap = F.col("count") * F.abs(F.col("mean_probability") - F.col("observed_rate"))
    table = bins.groupBy(*keys).agg(
        F.sum("count").alias("rows"), F.sum(gap).alias("_gap"), F.min("count").alias("smallest_bin"),
        F.count_if(F.col("lower_edge") == F.col("upper_edge")).alias("_flat"))
    reason = F.when(F.col("_flat") > 0, "duplicate quantile edges").when(F.col("smallest_bin") < min_count, "bin below minimum count")
    return table.withColumn("reason", reason).select(
        *keys, "rows", "smallest_bin", F.when(F.col("reason").isNull(), F.col("_gap") / F.col("rows")).alias("ece"), "reason")


# -- multiplicity and sequence rules (a handful of lines each) -----------------------------------------------------


def holm(tests: DataFrame, p: str = "p_value", keys: Sequence[str] = ("family",)) -> DataFrame:
    """Step-down adjusted p-values inside each family of hypotheses."""
    order = Window.partitionBy(*keys).orderBy(p, "hypothesis")
    left = F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1
    stepped = tests.withColumn("_step", F.least(N(1), left * F.col(p)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn("adjusted_p", F.max("_step").over(upto)).drop("_step")


def fixed_sequence(tests: DataFrame, position: str = "position", supported: str = "supported") -> DataFrame:
    """Each hypothesis is formally tested only while every earlier one was supported."""
    earlier = Window.partitionBy(F.lit(0)).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    gate = F.coalesce(F.min(F.col(supported).cast("int")).over(earlier) == 1, F.lit(True))
    ok = F.col(supported)
    return tests.withColumn("formally_tested", gate).withColumn(
        "status",
        F.when(~F.col("formally_tested"), "descriptive_after_gate_failure").when(ok, "supported").otherwise("not_supported_sequence_stops"))


# -- selection -----------------------------------------------------------------------------------------------------


def best_within_tolerance(candidates: DataFrame, risk: str, prefer: Sequence[Column], keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Lowest risk per key; among candidates within ``tolerance`` of it, the first by ``prefer``."""
    low = F.min(risk).over(Window.partitionBy(*keys))
    near = candidates.withColumn("_low", low).filter(F.col(risk) <= F.col("_low") + N(tolerance)).drop("_low")
    pick = Window.partitionBy(*keys).orderBy(*prefer)
    return near.withColumn("_n", F.row_number().over(pick)).filter("_n = 1").drop("_n")


def modal_choice(choices: DataFrame, value: str, prefer: Column, keys: Sequence[str]) -> DataFrame:
    """Most frequent value per key; ``prefer`` breaks ties."""
    counted = choices.groupBy(*keys, value).agg(F.count("*").alias("times"))
    pick = Window.partitionBy(*keys).orderBy(F.col("times").desc(), prefer)
    return counted.withColumn("_n", F.row_number().over(pick)).filter("_n = 1").drop("_n")


def top_units(units: DataFrame, rules: dict[str, tuple[str, bool]], k: int = 10, seed: str = "CASE_AUDIT", keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Top ``k`` units per rule (column, descending) with a pseudonym instead of the id; ties to the lower text id.

    The ``rank <= k`` filter lets Spark keep k lines per task before the shuffle.
    """
    out = None
    text_id = F.col(UNIT).cast("string")
    for rule, (column, descending) in rules.items():
        key = F.col(column).desc() if descending else F.col(column).asc()
        ranked = units.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(key, text_id))).filter(F.col("rank") <= k)
        picked = ranked.withColumns({"rule": F.lit(rule), "unit_key": S.keyed_digest(seed, text_id)}).drop(UNIT)
        out = picked if out is None else out.unionByName(picked)
    return out
