"""Unit-weighted risks, contrasts and the tables built on them.

The estimand is the mean over units of the mean over a unit's rows. Every function takes grouping keys (endpoint,
stratum, model), so one scan serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.ordering import exact_quantiles, positions, quantiles_of
from dyadlab.operators.pairs import SIDE, UNIT
from dyadlab.session import cut

N = S.number


def square(c: Column) -> Column:
    return c * c


def unit_means(rows: DataFrame, values: dict[str, Column], keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    return rows.groupBy(*keys, UNIT).agg(
        F.count("*").alias("unit_rows"), *[F.avg(c.cast("double")).alias(name) for name, c in values.items()]
    )


def mean_of_units(rows: DataFrame, values: dict[str, Column], keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Unit mean, then mean of units: each unit has weight one."""
    return unit_means(rows, values, keys).groupBy(*keys).agg(
        F.count("*").alias("units"), F.sum("unit_rows").alias("unit_rows"), *[F.avg(v).alias(v) for v in values]
    )


def unit_risks(rows: DataFrame, target: str = "nll", keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Per unit: observed loss, squared-error risk of both models, and their difference."""
    y = F.col(target)
    return unit_means(rows, {
        "observed_loss": y,
        "risk_r0": square(y - F.col(f"predicted_{target}_r0")),
        "risk_r1": square(y - F.col(f"predicted_{target}_r1")),
    }, keys).withColumn("contribution", F.col("risk_r0") - F.col("risk_r1"))


def risk_contrast(rows: DataFrame, target: str = "nll", keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    return contrast_of_units(unit_risks(rows, target, keys), keys)


def contrast_of_units(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    return units.groupBy(*keys).agg(
        F.count("*").alias("units"),
        F.sum("unit_rows").alias("rows"),
        F.avg("observed_loss").alias("mean_observed_loss"),
        F.avg("risk_r0").alias("risk_r0"),
        F.avg("risk_r1").alias("risk_r1"),
        F.avg("contribution").alias("delta"),
        F.avg((F.col("contribution") > 0).cast("double")).alias("positive_fraction"),
    ).withColumn("relative_delta", S.safe_ratio(F.col("delta"), F.col("risk_r0")))


def mae_improvement(rows: DataFrame, target: str = "nll", keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    y = F.col(target)
    gain = F.abs(y - F.col(f"predicted_{target}_r0")) - F.abs(y - F.col(f"predicted_{target}_r1"))
    return mean_of_units(rows, {"mae_improvement": gain}, keys)


# -- states ------------------------------------------------------------------------------------------------------


def state_counts(pairs: DataFrame, key: str = "endpoint", state: str = "state") -> DataFrame:
    """Units per state and their share; absent states are reported with zero."""
    counted = pairs.groupBy(key).agg(
        F.count("*").alias("_all"), *[F.count_if(F.col(state) == s).alias(s) for s in S.STATES]
    )
    long = counted.select(key, "_all", F.explode(F.array(*[
        F.struct(F.lit(s).alias("state"), F.col(f"`{s}`").alias("units")) for s in S.STATES
    ])).alias("_s")).select(key, "_all", "_s.*")
    return long.withColumn("percent_units", N(100) * S.safe_ratio(F.col("units"), F.col("_all"))).drop("_all")


def state_risk(rows: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Risk contrast inside each state with its population weight; weighted deltas add up to the overall delta."""
    states = F.when(F.col("side") == 1, S.pair_state(F.col("label"), F.col("partner_label"))).otherwise(
        S.pair_state(F.col("partner_label"), F.col("label")))
    table = risk_contrast(rows.withColumn("state", states), "nll", [*keys, "state"])
    total = table.groupBy(*keys).agg(F.sum("units").alias("_all"))
    return table.join(F.broadcast(total), list(keys)).withColumns({
        "population_weight": S.safe_ratio(F.col("units"), F.col("_all")),
    }).withColumn("weighted_delta", F.col("population_weight") * F.col("delta")).drop("_all")


def asymmetry(pairs: DataFrame) -> DataFrame:
    """Signed difference R - L of scores, their mean, and the difference oriented by the labels."""
    gap = F.col("z_r") - F.col("z_l")
    return pairs.withColumns({
        "asymmetry": gap,
        "evidence": (F.col("z_r") + F.col("z_l")) / N(2),
        "oriented_margin": (F.col("label_r") - F.col("label_l")) * gap,
    })


def asymmetry_summary(pairs: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    by = [*keys, "state"]
    rows = asymmetry(pairs).select(*by, UNIT, "asymmetry", "oriented_margin")
    ordered = positions(rows, ["asymmetry", UNIT], by)
    mixed = F.col("state").isin("10", "01")
    basic = ordered.groupBy(*by).agg(
        F.count("*").alias("units"),
        F.avg("asymmetry").alias("mean_a"),
        F.stddev_samp("asymmetry").alias("sd_a"),
        F.avg(F.when(mixed, F.col("oriented_margin"))).alias("mean_oriented"),
        F.avg(F.when(mixed, (F.col("oriented_margin") > 0).cast("double"))).alias("positive_oriented"),
    )
    cuts = quantiles_of(ordered, "asymmetry", {"q10_a": 0.1, "q25_a": 0.25, "median_a": 0.5, "q75_a": 0.75, "q90_a": 0.9}, by)
    # within 10 the margin is the asymmetry, within 01 its negative: one sort serves both medians
    sign = F.when(F.col("state") == "10", F.col("median_a")).when(F.col("state") == "01", -F.col("median_a"))
    return basic.join(cuts, by).withColumn("median_oriented", sign)


# -- strata ------------------------------------------------------------------------------------------------------


def quality_level_risk(rows: DataFrame, qualities: Sequence[str] = ("q1", "q2")) -> DataFrame:
    """Risk contrast per own quality level, both quality variables in one pass."""
    long = rows.withColumn("_q", F.explode(F.array(*[
        F.struct(F.lit(q).alias("quality"), F.col(q).alias("code")) for q in qualities
    ]))).withColumns({"quality": F.col("_q.quality"), "code": F.col("_q.code")})
    level = F.when(F.col("code") == S.NORMAL, "normal").when(F.col("code") == S.ABNORMAL, "abnormal")
    return risk_contrast(long.withColumn("level", level).filter(F.col("level").isNotNull()), "nll", ["endpoint", "quality", "level"])


def directional_risk(rows: DataFrame, qualities: Sequence[str] = ("q1", "q2")) -> DataFrame:
    """Risk contrast per own x partner stratum; a unit may put one side in each of two strata."""
    long = rows.withColumn("_q", F.explode(F.array(*[
        F.struct(F.lit(q).alias("quality"), S.directional_stratum(F.col(q), F.col(f"partner_{q}")).alias("stratum")) for q in qualities
    ]))).withColumns({"quality": F.col("_q.quality"), "stratum": F.col("_q.stratum")})
    return risk_contrast(long, "nll", ["endpoint", "quality", "stratum"])


def device_risk(rows: DataFrame, first: str, second: str, sparse_below: int = 10) -> DataFrame:
    own, other = F.col("device"), F.col("partner_device")
    table = risk_contrast(rows.withColumn("device_pair", S.device_pair(own, other, first, second)), "nll", ["endpoint", "device_pair"])
    note = F.when(F.col("units") < sparse_below, "very_sparse_descriptive").otherwise("estimable")
    return table.withColumn("precision_flag", note)


def cohort_table(rows: DataFrame) -> DataFrame:
    """Units, rows, positives, prevalence, errors and state counts per endpoint, in one aggregation: a unit is
    counted on its side-1 row."""
    right = F.col("side") == 1
    state = S.pair_state(F.col("label"), F.col("partner_label"))
    return rows.groupBy("endpoint").agg(
        F.count_if(right).alias("units"), F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"),
        F.avg(F.col("label").cast("double")).alias("prevalence"),
        F.count_if(F.col("predicted_class") != F.col("label")).alias("errors"),
        *[F.count_if(right & (state == s)).alias(f"state_{s}") for s in S.STATES],
    )


def confusion_rates(rows: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Rates at the class threshold; null where the class is absent."""
    y, c = F.col("label"), F.col("predicted_class").cast("double")
    return rows.groupBy(*keys).agg(
        F.count_if((y == 1) & (c == 1)).alias("true_positive"), F.count_if((y == 0) & (c == 1)).alias("false_positive"),
        F.count_if((y == 1) & (c == 0)).alias("false_negative"), F.count_if((y == 0) & (c == 0)).alias("true_negative"),
        F.avg(F.when(y == 1, c)).alias("sensitivity"), F.avg(F.when(y == 0, N(1) - c)).alias("specificity"),
    )


# -- diagnostics -------------------------------------------------------------------------------------------------


def residual_diagnostics(rows: DataFrame, target: str = "nll") -> DataFrame:
    observed = F.col(target)
    long = rows.select("endpoint", UNIT, SIDE, observed.alias("observed"), F.explode(F.array(*[
        F.struct(F.lit(m.upper()).alias("model"), (observed - F.col(f"predicted_{target}_{m}")).alias("residual")) for m in ("r0", "r1")
    ])).alias("_m")).select("endpoint", UNIT, SIDE, "observed", "_m.*")
    by = ["endpoint", "model"]
    ordered = positions(long, ["residual", UNIT, SIDE], by)
    r = F.col("residual")
    basic = ordered.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("sd_residual"),
        F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(square(r))).alias("rmse"), F.max(F.abs(r)).alias("max_abs_residual"),
        F.corr(F.abs(r), F.col("observed")).alias("corr_abs_observed"),
    )
    return basic.join(quantiles_of(ordered, "residual", {"q01": 0.01, "q50": 0.5, "q95": 0.95, "q99": 0.99}, by), by)


def top_share(units: DataFrame, measure: Column, total: str, out: str, fraction: float = 0.01) -> DataFrame:
    """Per endpoint: sum of ``total`` over the top ``fraction`` of units by ``measure`` (ties to the lower id)."""
    ordered = positions(units.select("endpoint", UNIT, measure.alias("_m"), F.col(total).alias("_v")), [F.col("_m").desc(), UNIT], ["endpoint"])
    size = F.greatest(F.lit(1), F.ceil(N(fraction) * F.col("group_rows")))
    return ordered.groupBy("endpoint").agg(F.sum(F.when(F.col("pos") < size, F.col("_v"))).alias(out))


def influence(units: DataFrame) -> DataFrame:
    """How far single units move the contrast. Leave-one-out means come from the total in closed form."""
    units = cut(units.select("endpoint", UNIT, "observed_loss", "contribution", F.abs("contribution").alias("_abs")))  # read by four passes
    x = F.col("contribution")
    basic = units.groupBy("endpoint").agg(
        F.count("*").alias("units"), F.avg(x).alias("delta"), F.min(x).alias("min_contribution"), F.max(x).alias("max_contribution"),
        F.avg((x > 0).cast("double")).alias("positive_fraction"), F.sum(x).alias("_net"), F.sum("_abs").alias("_total"),
        F.max_by(x, F.struct(F.col("_abs"), -F.col(UNIT))).alias("_strongest"),
    )
    cuts = exact_quantiles(units, "contribution", {"median_contribution": 0.5, "q05_contribution": 0.05, "q95_contribution": 0.95}, ["endpoint"], [UNIT])
    by_size = top_share(units, F.col("_abs"), "_abs", "_top_abs")
    by_loss = top_share(units, F.col("observed_loss"), "contribution", "_top_loss")
    one_less = F.col("units") - 1
    shift = F.greatest(F.abs(F.col("max_contribution") - F.col("delta")), F.abs(F.col("min_contribution") - F.col("delta")))
    return basic.join(cuts, "endpoint").join(by_size, "endpoint").join(by_loss, "endpoint").withColumns({
        "max_loo_shift": S.safe_ratio(shift, one_less),
        "delta_without_strongest": S.safe_ratio(F.col("_net") - F.col("_strongest"), one_less),
        "top1pct_abs_share": S.safe_ratio(F.col("_top_abs"), F.col("_total")),
        "top1pct_loss_net_share": S.safe_ratio(F.col("_top_loss"), F.col("_net")),
        "largest_positive_share": S.safe_ratio(F.col("max_contribution"), F.col("_net")),
        "largest_negative_share": S.safe_ratio(F.col("min_contribution"), F.col("_net")),
    }).drop("_net", "_total", "_strongest", "_top_abs", "_top_loss")


TAIL_BANDS = ("0-50%", "50-90%", "90-95%", "95-99%", "99-100%")
TAIL_CUTS = (0.5, 0.9, 0.95, 0.99)


def loss_tail(units: DataFrame) -> DataFrame:
    """Contrast in bands (low, high] of the unit's observed loss; an empty band still appears."""
    units = cut(units)
    names = [f"c{i}" for i in range(len(TAIL_CUTS))]
    cuts = exact_quantiles(units, "observed_loss", dict(zip(names, TAIL_CUTS)), ["endpoint"], [UNIT])
    chain = F
    for i, name in enumerate(names):
        chain = chain.when(F.col("observed_loss") <= F.col(name), F.lit(i))
    banded = units.join(F.broadcast(cuts), "endpoint").withColumn("_band", chain.otherwise(F.lit(len(names))))
    sums = banded.groupBy("endpoint", "_band").agg(
        F.count("*").alias("units"), F.avg("observed_loss").alias("mean_observed"), F.avg("risk_r0").alias("risk_r0"),
        F.avg("risk_r1").alias("risk_r1"), F.avg("contribution").alias("delta"), F.sum("contribution").alias("_sum"),
    )
    net = units.groupBy("endpoint").agg(F.sum("contribution").alias("_net"))
    lows, highs = [None, *names], [*names, None]
    frame = cuts.join(net, "endpoint").select("endpoint", "_net", F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("_band"), F.lit(text).alias("band"),
            (F.col(lo) if lo else F.lit(None).cast("double")).alias("lower_exclusive"),
            (F.col(hi) if hi else F.lit(None).cast("double")).alias("upper_inclusive"),
        ) for i, (text, lo, hi) in enumerate(zip(TAIL_BANDS, lows, highs))
    ])).alias("_b")).select("endpoint", "_net", "_b.*")
    return frame.join(sums, ["endpoint", "_band"], "left").withColumns({
        "units": F.coalesce("units", F.lit(0)), "net_share": S.safe_ratio(F.coalesce("_sum", N(0)), F.col("_net")),
    }).drop("_band", "_sum", "_net")


def contribution_histogram(units: DataFrame, bins: int = 36, tail: float = 0.01) -> DataFrame:
    """Equal-width counts between the outer quantiles, last bin closed, with the counts outside."""
    ordered = positions(units.select("endpoint", UNIT, "contribution"), ["contribution", UNIT], ["endpoint"])
    ends = quantiles_of(ordered, "contribution", {"_q_low": tail, "_q_high": 1 - tail}, ["endpoint"])
    x = F.col("contribution")
    placed = ordered.join(F.broadcast(ends), "endpoint")
    inside = (x >= F.col("_q_low")) & (x <= F.col("_q_high"))
    span = placed.groupBy("endpoint").agg(
        F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"),
        F.count_if(x < F.col("_q_low")).alias("below"), F.count_if(x > F.col("_q_high")).alias("above"),
    )
    step = (F.col("high") - F.col("low")) / N(bins)
    slot = F.least(F.floor((x - F.col("low")) / step), F.lit(bins - 1)).cast("int")
    counts = placed.filter(inside).select("endpoint", "contribution").join(F.broadcast(span), "endpoint").groupBy(
        "endpoint", slot.alias("bin")).agg(F.count("*").alias("units"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, ["endpoint", "bin"], "left").select(
        "endpoint", "bin", "below", "above", (F.col("low") + step * F.col("bin")).alias("bin_low"),
        (F.col("low") + step * (F.col("bin") + 1)).alias("bin_high"), F.coalesce("units", F.lit(0)).alias("units"),
    )


def quality_patterns(pairs: DataFrame) -> DataFrame:
    """Pair pattern of each quality variable with units, percent, and the variable's abnormal/unevaluable rows."""
    long = pairs.select(F.explode(F.array(*[
        F.struct(
            F.lit(q).alias("quality"), S.quality_pattern_whole(F.col(f"{q}_r"), F.col(f"{q}_l")).alias("pattern"),
            sum((F.coalesce((F.col(f"{q}_{s}") == S.ABNORMAL).cast("int"), F.lit(0)) for s in "rl"), F.lit(0)).alias("bad"),
            sum((S.unevaluable(F.col(f"{q}_{s}")).cast("int") for s in "rl"), F.lit(0)).alias("unknown"),
        ) for q in ("q1", "q2")
    ])).alias("_q")).select("_q.*")
    table = long.groupBy("quality", "pattern").agg(F.count("*").alias("units"), F.sum("bad").alias("_bad"), F.sum("unknown").alias("_unknown"))
    total = table.groupBy("quality").agg(
        F.sum("units").alias("_all"), F.sum("_bad").alias("abnormal_rows"), F.sum("_unknown").alias("unevaluable_rows"))
    return table.join(F.broadcast(total), "quality").select(
        "quality", "pattern", "units", (N(100) * F.col("units") / F.col("_all")).alias("percent_units"), "abnormal_rows", "unevaluable_rows")


def complete_pairs(pairs: DataFrame, quality: str = "q2", keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    ok = ~S.unevaluable(F.col(f"{quality}_r")) & ~S.unevaluable(F.col(f"{quality}_l"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("units"), F.count_if(ok).alias("complete_units"))
