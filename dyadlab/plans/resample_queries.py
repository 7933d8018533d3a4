"""Bootstrap, intervals, sequence and multiplicity rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import ranked_bootstrap as RB
from dyadlab.operators import ranking as R
from dyadlab.operators import resample as B
from dyadlab.operators import risk as K
from dyadlab.plans.registry import query
from dyadlab.plans.risk_queries import RANKING_SQL, rounded
from dyadlab.plans.views import ENDPOINTS, PAIRS_SQL, ROWS_SQL, UNITS_SQL, pair_predictions, predictions
from dyadlab.session import cut

N = S.number
SEED, CHECK_SEEDS, REPLICATES = 20261001, (20261011, 20261021), 200


def draw_sql(sizes: str, keys: str, seeds, replicates: int) -> str:
    """Common table expressions ``draw(keys, seed, replicate, pos)`` from ``sizes(keys, n)``."""
    k = ", ".join(f"z.{c.strip()}" for c in keys.split(","))
    return f""", seeds AS (SELECT UNNEST([{', '.join(map(str, seeds))}]) AS seed),
reps AS (SELECT CAST(r AS BIGINT) AS replicate FROM range({replicates}) t(r)),
blocks AS (SELECT {k}, z.n, seed, replicate, UNNEST(RANGE(CAST((z.n - 1) // 4 + 1 AS BIGINT))) AS block FROM {sizes} z, seeds, reps),
hashed AS (SELECT *, SHA256(seed || '|' || replicate || '|' || block) AS digest FROM blocks),
draw AS (SELECT {keys}, seed, replicate, ('0x' || SUBSTR(digest, CAST(1 + 15 * m AS BIGINT), 15))::BIGINT % n AS pos FROM hashed, range(4) q(m) WHERE block * 4 + m < n)
"""


def boot_sql(values: str, keys: str = "endpoint", seeds=(SEED,), replicates: int = REPLICATES) -> str:
    on = " AND ".join(f"d.{c.strip()} = i.{c.strip()}" for c in keys.split(","))
    k = ", ".join(f"d.{c.strip()}" for c in keys.split(","))
    return f""", vals AS ({values}), idx AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY unit_id) - 1 AS pos FROM vals),
sizes AS (SELECT {keys}, COUNT(*) AS n FROM vals GROUP BY {keys})""" + draw_sql("sizes", keys, seeds, replicates) + f""",
boot AS (SELECT {k}, d.seed, d.replicate, AVG(i.v) AS mean FROM draw d JOIN idx i ON {on} AND d.pos = i.pos GROUP BY {k}, d.seed, d.replicate)
"""


NLL_VALUES = "SELECT endpoint, unit_id, contribution AS v FROM contrib"


def contributions(spark, folder):
    return K.unit_risks(predictions(spark, folder)).select("endpoint", "unit_id", "contribution")


@query("bootstrap_means", UNITS_SQL + boot_sql(NLL_VALUES) + "SELECT endpoint, CAST(seed AS INTEGER) AS seed, CAST(replicate AS INTEGER) AS replicate, ROUND(mean, 9) AS mean FROM boot")
def bootstrap_means(spark, folder):
    return rounded(B.bootstrap_means(contributions(spark, folder), "contribution", REPLICATES, [SEED]), 9)


DIAG = """, vbase AS (SELECT endpoint, COUNT(*) AS units, AVG(v) AS m, MAX(v) - MIN(v) AS value_range FROM vals GROUP BY endpoint),
acc AS (SELECT b.endpoint, SUM(POW(v - m, 3)) / (6 * POW(SUM(POW(v - m, 2)), 1.5)) AS acceleration FROM vals JOIN vbase b ON vals.endpoint = b.endpoint GROUP BY b.endpoint),
dg AS (SELECT o.endpoint, seed, COUNT(*) AS replicates, AVG(mean) AS bm, STDDEV_SAMP(mean) AS bs, MIN(mean) AS lo, MAX(mean) AS hi,
  GREATEST(0.5 / COUNT(*), LEAST(1 - 0.5 / COUNT(*), (COUNT(*) FILTER (WHERE mean < m) + 0.5 * COUNT(*) FILTER (WHERE mean = m)) / COUNT(*))) AS fl, MAX(m) AS m,
  QUANTILE_CONT(mean, 0.025) AS q_low, QUANTILE_CONT(mean, 0.975) AS q_high, QUANTILE_CONT(mean, 0.05) AS q05 FROM boot o JOIN vbase b ON o.endpoint = b.endpoint GROUP BY o.endpoint, seed)
"""


@query("bootstrap_diagnostics", UNITS_SQL + boot_sql(NLL_VALUES, seeds=(SEED, *CHECK_SEEDS), replicates=100) + DIAG + """SELECT dg.endpoint, CAST(seed AS INTEGER) AS seed, replicates, ROUND(bm, 8) AS replicate_mean, ROUND(bs, 8) AS replicate_sd, ROUND(lo, 8) AS replicate_min,
  ROUND(hi, 8) AS replicate_max, ROUND(CAST(fl AS DOUBLE), 8) AS fraction_less, units, ROUND(dg.m, 8) AS estimate, ROUND(value_range, 8) AS value_range, ROUND(acceleration, 8) AS acceleration, ROUND(bm - dg.m, 8) AS bias
FROM dg JOIN vbase b ON dg.endpoint = b.endpoint JOIN acc ON acc.endpoint = b.endpoint""")
def bootstrap_diagnostics(spark, folder):
    """Primary seed and both check seeds on the same contributions."""
    values = cut(contributions(spark, folder))
    means = B.bootstrap_means(values, "contribution", 100, [SEED, *CHECK_SEEDS])
    return rounded(B.diagnostics(values, means, "contribution"))


@query("percentile_interval", UNITS_SQL + boot_sql(NLL_VALUES) + DIAG + "SELECT endpoint, CAST(seed AS INTEGER) AS seed, ROUND(q_low, 8) AS lower, ROUND(q_high, 8) AS upper FROM dg")
def percentile_interval(spark, folder):
    means = B.bootstrap_means(contributions(spark, folder), "contribution", REPLICATES, [SEED])
    return rounded(means.groupBy("endpoint", "seed").agg(F.percentile("mean", N(0.025)).alias("lower"), F.percentile("mean", N(0.975)).alias("upper")))


@query("bca_interval")
def bca_interval(spark, folder):
    return B.bca_interval(cut(contributions(spark, folder)), "contribution", 1000, [SEED, *CHECK_SEEDS])


@query("one_sided_lower_bound")
def one_sided_lower_bound(spark, folder):
    return B.one_sided_lower(cut(contributions(spark, folder)), "contribution", 1000, SEED)


@query("state_stratified_bootstrap", UNITS_SQL + boot_sql("SELECT c.endpoint, state, c.unit_id, contribution AS v FROM contrib c JOIN pair p ON c.unit_id = p.unit_id AND c.endpoint = p.endpoint", "endpoint, state", replicates=50)
       + "SELECT endpoint, state, COUNT(*) AS replicates, ROUND(AVG(mean), 8) AS replicate_mean, ROUND(QUANTILE_CONT(mean, 0.025), 8) AS lower, ROUND(QUANTILE_CONT(mean, 0.975), 8) AS upper FROM boot GROUP BY endpoint, state")
def state_stratified_bootstrap(spark, folder):
    rows = predictions(spark, folder)
    state = F.when(F.col("side") == 1, S.pair_state(F.col("label"), F.col("partner_label"))).otherwise(S.pair_state(F.col("partner_label"), F.col("label")))
    keys = ["endpoint", "state"]
    means = B.bootstrap_means(K.unit_risks(rows.withColumn("state", state), "nll", keys), "contribution", 50, [SEED], keys)
    return rounded(means.groupBy(*keys).agg(
        F.count("*").alias("replicates"), F.avg("mean").alias("replicate_mean"), F.percentile("mean", N(0.025)).alias("lower"), F.percentile("mean", N(0.975)).alias("upper")))


@query("margin_contrast", PAIRS_SQL + boot_sql("SELECT endpoint, state, unit_id, (label_r - label_l) * (z_r - z_l) AS v FROM pair WHERE state IN ('10', '01')", "endpoint, state", replicates=50) + """,
w AS (SELECT endpoint, replicate, MAX(mean) FILTER (WHERE state = '10') - MAX(mean) FILTER (WHERE state = '01') AS d FROM boot GROUP BY endpoint, replicate),
e AS (SELECT endpoint, AVG(v) FILTER (WHERE state = '10') - AVG(v) FILTER (WHERE state = '01') AS estimate FROM vals GROUP BY endpoint)
SELECT e.endpoint, ROUND(MAX(estimate), 7) AS estimate, ROUND(QUANTILE_CONT(d, 0.025), 7) AS lower, ROUND(QUANTILE_CONT(d, 0.975), 7) AS upper FROM w JOIN e ON w.endpoint = e.endpoint GROUP BY e.endpoint""")
def margin_contrast(spark, folder):
    """Oriented margin of state 10 minus state 01: both states resampled separately."""
    keys = ["endpoint", "state"]
    values = cut(K.asymmetry(pair_predictions(spark, folder)).filter(F.col("state").isin("10", "01")).select(*keys, "unit_id", "oriented_margin"))
    gap = lambda c: F.max(F.when(F.col("state") == "10", c)) - F.max(F.when(F.col("state") == "01", c))
    means = B.bootstrap_means(values, "oriented_margin", 50, [SEED], keys).groupBy("endpoint", "replicate").agg(gap(F.col("mean")).alias("d"))
    point = values.groupBy(*keys).agg(F.avg("oriented_margin").alias("m")).groupBy("endpoint").agg(gap(F.col("m")).alias("estimate"))
    return rounded(point.join(means.groupBy("endpoint").agg(F.percentile("d", N(0.025)).alias("lower"), F.percentile("d", N(0.975)).alias("upper")), "endpoint"), 7)


CLUSTER_REPLICATES = 10_000  # as the reference's protocol has it


@query("cluster_bootstrap_auroc", ROWS_SQL + ", u AS (SELECT DISTINCT endpoint, unit_id FROM pred), ui AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY endpoint ORDER BY unit_id) - 1 AS pos FROM u), sizes AS (SELECT endpoint, COUNT(*) AS n FROM u GROUP BY endpoint)"
       + draw_sql("sizes", "endpoint", (SEED,), CLUSTER_REPLICATES) + """, rs AS (SELECT d.endpoint, d.replicate, p.label, p.prob FROM draw d JOIN ui ON d.endpoint = ui.endpoint AND d.pos = ui.pos JOIN pred p ON p.endpoint = ui.endpoint AND p.unit_id = ui.unit_id),
both_runs AS (SELECT * FROM rs UNION ALL SELECT endpoint, -1, label, prob FROM pred)""" + RANKING_SQL.format(keys="endpoint, replicate", score="prob", y="label", rows="both_runs") + f""", v AS (SELECT endpoint, replicate, area / positives / negatives AS auroc FROM a)
SELECT v.endpoint, ROUND(MAX(auroc) FILTER (WHERE replicate = -1), 8) AS estimate, COUNT(*) FILTER (WHERE replicate >= 0) AS valid_replicates, ROUND(QUANTILE_CONT(auroc, 0.025) FILTER (WHERE replicate >= 0), 8) AS lower,
  ROUND(QUANTILE_CONT(auroc, 0.975) FILTER (WHERE replicate >= 0), 8) AS upper, MAX(s.n) AS units, {CLUSTER_REPLICATES} AS requested_replicates FROM v JOIN sizes s ON v.endpoint = s.endpoint GROUP BY v.endpoint""")
def cluster_bootstrap_auroc(spark, folder):
    """Both sides of a unit travel together; the AUROC of every replicate comes from weights carried along the scores."""
    rows = cut(predictions(spark, folder).select("endpoint", "unit_id", "side", "label", "prob"))
    point = R.binary_ranking(rows, F.col("label"), "prob").select("endpoint", F.col("auroc").alias("estimate"))
    return rounded(point.join(RB.cluster_intervals(rows, "label", "prob", "auroc", CLUSTER_REPLICATES, SEED), "endpoint"))


POSITION = "CASE endpoint " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(ENDPOINTS)) + " END"


@query("fixed_sequence", UNITS_SQL + boot_sql(NLL_VALUES) + DIAG + f""", s AS (SELECT endpoint, {POSITION} AS position, q05, q05 > 0 AS supported FROM dg),
g AS (SELECT *, COALESCE(BOOL_AND(supported) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS formally_tested FROM s)
SELECT endpoint, CAST(position AS INTEGER) AS position, ROUND(q05, 8) AS lower, supported, formally_tested,
  CASE WHEN NOT formally_tested THEN 'descriptive_after_gate_failure' WHEN supported THEN 'supported' ELSE 'not_supported_sequence_stops' END AS status FROM g""")
def fixed_sequence(spark, folder):
    """Each endpoint's one-sided percentile bound in the fixed order of the endpoints."""
    means = B.bootstrap_means(contributions(spark, folder), "contribution", REPLICATES, [SEED])
    bounds = means.groupBy("endpoint").agg(F.percentile("mean", N(0.05)).alias("lower"))
    place = F.array_position(F.array(*map(F.lit, ENDPOINTS)), F.col("endpoint")).cast("int") - 1
    return rounded(R.fixed_sequence(bounds.withColumns({"position": place, "supported": F.col("lower") > 0})))


@query("holm_adjustment", UNITS_SQL + """, h AS (SELECT 'family' AS family, endpoint || '/' || state AS hypothesis, ROUND(AVG(CASE WHEN contribution <= 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) * 0.1, 8) AS p_value FROM contrib JOIN pair USING (unit_id, endpoint) GROUP BY endpoint, state),
o AS (SELECT *, COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY p_value, hypothesis) + 1 AS k, ROW_NUMBER() OVER (ORDER BY p_value, hypothesis) AS rn FROM h)
SELECT family, hypothesis, p_value, ROUND(MAX(LEAST(1.0, k * p_value)) OVER (ORDER BY rn), 8) AS adjusted_p FROM o""")
def holm_adjustment(spark, folder):
    """Step-down rule on a family of twelve values (a share of units per endpoint and state stands in for p)."""
    rows = predictions(spark, folder)
    state = F.when(F.col("side") == 1, S.pair_state(F.col("label"), F.col("partner_label"))).otherwise(S.pair_state(F.col("partner_label"), F.col("label")))
    units = K.unit_risks(rows.withColumn("state", state), "nll", ["endpoint", "state"])
    tests = units.groupBy("endpoint", "state").agg(F.round(F.avg((F.col("contribution") <= 0).cast("double")) * N(0.1), 8).alias("p_value"))
    return rounded(R.holm(tests.select(F.lit("family").alias("family"), F.concat_ws("/", "endpoint", "state").alias("hypothesis"), "p_value")))


@query("reproduction_check", UNITS_SQL + """, a AS (SELECT endpoint, AVG(risk_r0) AS r0, AVG(contribution) AS d FROM contrib GROUP BY endpoint),
b AS (SELECT endpoint, AVG((nll - predicted_nll_r0) * (nll - predicted_nll_r0)) AS r0, AVG((nll - predicted_nll_r0) * (nll - predicted_nll_r0)) - AVG((nll - predicted_nll_r1) * (nll - predicted_nll_r1)) AS d FROM pred GROUP BY endpoint)
SELECT a.endpoint, ROUND(GREATEST(ABS(a.r0 - b.r0), ABS(a.d - b.d)), 9) AS max_abs_difference, GREATEST(ABS(a.r0 - b.r0), ABS(a.d - b.d)) < 1e-9 AS reproduced FROM a JOIN b ON a.endpoint = b.endpoint""")
def reproduction_check(spark, folder):
    """The contrast recomputed along another route: with two rows per unit the row mean must equal the unit mean."""
    rows = predictions(spark, folder)
    first = K.risk_contrast(rows).select("endpoint", "risk_r0", "delta")
    r0, r1 = (F.avg(K.square(F.col("nll") - F.col(f"predicted_nll_{m}"))) for m in ("r0", "r1"))
    again = rows.groupBy("endpoint").agg(r0.alias("risk_r0"), (r0 - r1).alias("delta"))
    return rounded(B.reproduction_check(first, again, ["endpoint"], ["risk_r0", "delta"], 1e-9), 9)
