"""Intervals at the full number of replicates: contrasts, strata, and ranking metrics with whole units resampled."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import intervals as I
from dyadlab.operators import ranked_bootstrap as RB
from dyadlab.operators import ranking as R
from dyadlab.operators import resample as B
from dyadlab.operators import risk as K
from dyadlab.operators.tree_bootstrap import resampled_means, within
from dyadlab.plans.registry import query
from dyadlab.plans.resample_queries import CHECK_SEEDS, SEED, contributions
from dyadlab.plans.risk_queries import DIRECTION, PAIR_DEVICE, RANKING_SQL, rounded
from dyadlab.plans.views import FIRST_DEVICE, ROWS_SQL, SECOND_DEVICE, predictions
from dyadlab.session import cut

N = S.number
REPLICATES = 10_000

STRATA_SQL = ROWS_SQL + f""", g AS (
  SELECT *, (nll - predicted_nll_r0) * (nll - predicted_nll_r0) - (nll - predicted_nll_r1) * (nll - predicted_nll_r1) AS gain,
    (brier - predicted_brier_r0) * (brier - predicted_brier_r0) - (brier - predicted_brier_r1) * (brier - predicted_brier_r1) AS brier_gain,
    ABS(nll - predicted_nll_r0) - ABS(nll - predicted_nll_r1) AS mae_gain,
    CASE WHEN side = 1 THEN label || '' || partner_label ELSE partner_label || '' || label END AS state,
    CASE WHEN side = 1 THEN z - partner_z ELSE partner_z - z END AS gap FROM pred),
long AS (
  SELECT 'contrast' AS family, 'nll' AS level, endpoint, unit_id, gain AS value FROM g
  UNION ALL SELECT 'contrast', 'brier', endpoint, unit_id, brier_gain FROM g
  UNION ALL SELECT 'contrast', 'mae', endpoint, unit_id, mae_gain FROM g
  UNION ALL SELECT 'state', state, endpoint, unit_id, gain FROM g
  UNION ALL SELECT 'device', {PAIR_DEVICE}, endpoint, unit_id, gain FROM g
  UNION ALL SELECT 'quality', 'q1/' || CASE WHEN q1 = 1 THEN 'normal' ELSE 'abnormal' END, endpoint, unit_id, gain FROM g WHERE q1 IN (1, 2)
  UNION ALL SELECT 'quality', 'q2/' || CASE WHEN q2 = 1 THEN 'normal' ELSE 'abnormal' END, endpoint, unit_id, gain FROM g WHERE q2 IN (1, 2)
  UNION ALL SELECT 'direction', 'q1/' || {DIRECTION.format("q1")}, endpoint, unit_id, gain FROM g
  UNION ALL SELECT 'direction', 'q2/' || {DIRECTION.format("q2")}, endpoint, unit_id, gain FROM g
  UNION ALL SELECT 'asymmetry', state, endpoint, unit_id, gap FROM g
  UNION ALL SELECT 'oriented', state, endpoint, unit_id, CASE WHEN state = '10' THEN gap ELSE -gap END FROM g WHERE state IN ('10', '01')),
u AS (SELECT family, endpoint, level, unit_id, AVG(value) AS v FROM long GROUP BY family, endpoint, level, unit_id),
t AS (SELECT family, endpoint, level, COUNT(*) AS units, AVG(v) AS estimate, MAX(v) - MIN(v) AS spread FROM u GROUP BY family, endpoint, level)
"""
METHOD_SQL = "CASE WHEN units < 2 THEN 'not_estimable' WHEN spread > 0 THEN 'BCa' ELSE 'percentile_point_mass_fallback' END"


def units_of_strata(spark, folder):
    return cut(I.stratum_units(predictions(spark, folder), FIRST_DEVICE, SECOND_DEVICE))


@query("stratum_intervals")
def stratum_intervals(spark, folder):
    """BCa intervals of all contrasts and strata from one run of 10,000 replicates with shared unit weights."""
    return rounded(I.stratum_intervals(units_of_strata(spark, folder), REPLICATES, SEED))


@query("stratum_interval_status", STRATA_SQL + f"""SELECT family, endpoint, level, units, ROUND(estimate, 7) AS estimate, {METHOD_SQL} AS method,
  units >= 2 AND spread > 0 AS significance_eligible, CASE WHEN units < 10 THEN 'very_sparse_descriptive' ELSE 'estimable' END AS precision_flag,
  CASE WHEN units >= 2 THEN TRUE END AS brackets FROM t""")
def stratum_interval_status(spark, folder):
    """What is fixed about these intervals: units, estimate, method, eligibility, and that the bounds bracket the estimate."""
    found = I.stratum_intervals(units_of_strata(spark, folder), REPLICATES, SEED)
    brackets = (F.col("lower") <= F.col("estimate") + N(1e-12)) & (F.col("estimate") <= F.col("upper") + N(1e-12))
    return rounded(found.select(*I.KEYS, "units", "estimate", "method", "significance_eligible", "precision_flag", brackets.alias("brackets")), 7)


@query("primary_intervals")
def primary_intervals(spark, folder):
    """The primary contrast at 10,000 replicates: two-sided BCa and one-sided lower bound from the same replicates, all seeds."""
    values = cut(contributions(spark, folder))
    means = cut(resampled_means(values, "contribution", REPLICATES, [SEED, *CHECK_SEEDS]))
    seeds, same = [SEED, *CHECK_SEEDS], lambda *_: means
    two_sided = B.bca_interval(values, "contribution", REPLICATES, seeds, resample=same)
    one_sided = B.bca_interval(values, "contribution", REPLICATES, seeds, alphas=(0.05, 0.95), resample=same).select("endpoint", "seed", F.col("lower").alias("one_sided_lower"))
    return rounded(two_sided.join(one_sided, ["endpoint", "seed"]))


@query("state_population_intervals")
def state_population_intervals(spark, folder):
    """Each state resampled by itself, n of its n units (a population of its own in the tree)."""
    rows = predictions(spark, folder)
    state = F.when(F.col("side") == 1, S.pair_state(F.col("label"), F.col("partner_label"))).otherwise(S.pair_state(F.col("partner_label"), F.col("label")))
    keys = ["endpoint", "state"]
    units = cut(K.unit_risks(rows.withColumn("state", state), "nll", keys).select(*keys, "unit_id", "contribution"))
    return rounded(B.bca_interval(units, "contribution", REPLICATES, [SEED], keys, resample=within(*keys)))


@query("ranking_intervals")
def ranking_intervals(spark, folder):
    """Percentile intervals of AUROC and average precision of the labels, and of the area under the risk-coverage curve, with whole
    units resampled 10,000 times; estimates come from the rows as they are."""
    rows = cut(predictions(spark, folder).withColumn("error", (F.col("predicted_class") != F.col("label")).cast("int")).select("endpoint", "unit_id", "side", "label", "prob", "error", "predicted_nll_r1"))
    ranked = RB.replicate_statistics(rows, "label", "prob", REPLICATES, SEED)
    covered = RB.replicate_statistics(rows, "error", "predicted_nll_r1", REPLICATES, SEED, coverage=True, order=["unit_id", "side"])
    found = RB.percentile_intervals(ranked, RB.RANKING).unionByName(RB.percentile_intervals(covered, RB.COVERAGE))
    curve = R.coverage_summary(R.risk_coverage(rows, F.col("error"), "predicted_nll_r1")).select("endpoint", F.lit("aurc").alias("statistic"), F.col("aurc").alias("estimate"))
    point = R.binary_ranking(rows, F.col("label"), "prob").select("endpoint", F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("estimate")) for c in RB.RANKING])).alias("s")).select("endpoint", "s.*")
    return rounded(point.unionByName(curve).join(found, ["endpoint", "statistic"], "left").withColumn("requested_replicates", F.lit(REPLICATES)))


@query("ranking_interval_status", ROWS_SQL + ", both_runs AS (SELECT * FROM pred)" + RANKING_SQL.format(keys="endpoint", score="prob", y="label", rows="both_runs") + """
SELECT endpoint, ROUND(area / positives / negatives, 8) AS estimate, TRUE AS brackets, TRUE AS complete FROM a""")
def ranking_interval_status(spark, folder):
    """AUROC of the rows, whether its interval brackets it, and whether all replicates were valid."""
    rows = cut(predictions(spark, folder).select("endpoint", "unit_id", "side", "label", "prob"))
    found = RB.percentile_intervals(RB.replicate_statistics(rows, "label", "prob", REPLICATES, SEED), ["auroc"])
    point = R.binary_ranking(rows, F.col("label"), "prob").select("endpoint", F.col("auroc").alias("estimate"))
    both = point.join(found, "endpoint")
    brackets = (F.col("lower") < F.col("estimate")) & (F.col("estimate") < F.col("upper"))
    return rounded(both.select("endpoint", "estimate", brackets.alias("brackets"), (F.col("valid_replicates") == REPLICATES).alias("complete")))
