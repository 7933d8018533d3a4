"""Risk tables, strata, diagnostics and ranking metrics on the paired order view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import pairs as P
from dyadlab.operators import ranking as R
from dyadlab.operators import risk as K
from dyadlab.plans.registry import query
from dyadlab.plans.views import ENDPOINTS, FIRST_DEVICE, PAIRS_SQL, ROWS_SQL, SECOND_DEVICE, UNITS_SQL, pair_predictions, predictions
from dyadlab.session import cut

RISK_SQL = """COUNT(*) AS units, AVG(observed_loss) AS mean_observed_loss, AVG(risk_r0) AS risk_r0, AVG(risk_r1) AS risk_r1,
  AVG(contribution) AS delta, AVG(CASE WHEN contribution > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS positive_fraction"""
FINISH = """units, CAST(rows AS BIGINT) AS rows, ROUND(mean_observed_loss, 8) AS mean_observed_loss, ROUND(risk_r0, 8) AS risk_r0,
  ROUND(risk_r1, 8) AS risk_r1, ROUND(delta, 8) AS delta, ROUND(positive_fraction, 6) AS positive_fraction,
  ROUND(CASE WHEN risk_r0 = 0 THEN NULL ELSE delta / risk_r0 END, 6) AS relative_delta"""


def rounded(df: DataFrame, places: int = 8, **special: int) -> DataFrame:
    """Round every double at the query edge, where engines may differ in the last bits of a sum."""
    return df.select(*[
        F.round(F.col(f.name), special.get(f.name, places)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema
    ])


def risk_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, positive_fraction=6, relative_delta=6)


def strata_sql(rows: str, keys: str, extra: str = "") -> str:
    """Risk contrast of ``rows`` (a SELECT over ``pred`` with the stratum columns) by ``keys``."""
    return ROWS_SQL + f""", strat AS ({rows}),
u AS (SELECT {keys}, unit_id, COUNT(*) AS n, AVG(nll) AS observed_loss,
    AVG((nll - predicted_nll_r0) * (nll - predicted_nll_r0)) AS risk_r0, AVG((nll - predicted_nll_r1) * (nll - predicted_nll_r1)) AS risk_r1
  FROM strat GROUP BY {keys}, unit_id),
c AS (SELECT *, risk_r0 - risk_r1 AS contribution FROM u),
t AS (SELECT {keys}, SUM(n) AS rows, {RISK_SQL} FROM c GROUP BY {keys})
SELECT {keys}, {FINISH}{extra} FROM t"""


def contrast_sql(target: str) -> str:
    return ROWS_SQL + f""",
u AS (SELECT endpoint, unit_id, COUNT(*) AS n, AVG({target}) AS observed_loss,
    AVG(({target} - predicted_{target}_r0) * ({target} - predicted_{target}_r0)) AS risk_r0,
    AVG(({target} - predicted_{target}_r1) * ({target} - predicted_{target}_r1)) AS risk_r1 FROM pred GROUP BY endpoint, unit_id),
c AS (SELECT *, risk_r0 - risk_r1 AS contribution FROM u),
t AS (SELECT endpoint, SUM(n) AS rows, {RISK_SQL} FROM c GROUP BY endpoint)
SELECT endpoint, {FINISH} FROM t"""


@query("risk_contrast", contrast_sql("nll"))
def risk_contrast(spark, folder):
    return risk_rounded(K.risk_contrast(predictions(spark, folder)))


@query("risk_contrast_brier", contrast_sql("brier"))
def risk_contrast_brier(spark, folder):
    return risk_rounded(K.risk_contrast(predictions(spark, folder), "brier"))


@query("unit_mean_loss", ROWS_SQL + """, u AS (SELECT endpoint, unit_id, COUNT(*) AS n, AVG(nll) AS nll, AVG(brier) AS brier FROM pred GROUP BY endpoint, unit_id)
SELECT endpoint, COUNT(*) AS units, CAST(SUM(n) AS BIGINT) AS unit_rows, ROUND(AVG(nll), 8) AS nll, ROUND(AVG(brier), 8) AS brier FROM u GROUP BY endpoint""")
def unit_mean_loss(spark, folder):
    return rounded(K.mean_of_units(predictions(spark, folder), {"nll": F.col("nll"), "brier": F.col("brier")}))


@query("mae_improvement", ROWS_SQL + """, u AS (SELECT endpoint, unit_id, COUNT(*) AS n,
  AVG(ABS(nll - predicted_nll_r0) - ABS(nll - predicted_nll_r1)) AS g FROM pred GROUP BY endpoint, unit_id)
SELECT endpoint, COUNT(*) AS units, CAST(SUM(n) AS BIGINT) AS unit_rows, ROUND(AVG(g), 8) AS mae_improvement FROM u GROUP BY endpoint""")
def mae_improvement(spark, folder):
    return rounded(K.mae_improvement(predictions(spark, folder)))


@query("state_counts", PAIRS_SQL + """, states AS (SELECT UNNEST(['00', '11', '10', '01']) AS state),
grid AS (SELECT e.endpoint, s.state FROM (SELECT DISTINCT endpoint FROM pair) e, states s),
n AS (SELECT endpoint, state, COUNT(*) AS units FROM pair GROUP BY endpoint, state),
f AS (SELECT g.endpoint, g.state, COALESCE(n.units, 0) AS units FROM grid g LEFT JOIN n ON g.endpoint = n.endpoint AND g.state = n.state)
SELECT endpoint, state, units, ROUND(100.0 * units / SUM(units) OVER (PARTITION BY endpoint), 8) AS percent_units FROM f""")
def state_counts(spark, folder):
    return rounded(K.state_counts(pair_predictions(spark, folder)))


@query("state_risk", ROWS_SQL + f""", strat AS (SELECT *, CASE WHEN side = 1 THEN label || '' || partner_label ELSE partner_label || '' || label END AS state FROM pred),
u AS (SELECT endpoint, state, unit_id, COUNT(*) AS n, AVG(nll) AS observed_loss,
    AVG((nll - predicted_nll_r0) * (nll - predicted_nll_r0)) AS risk_r0, AVG((nll - predicted_nll_r1) * (nll - predicted_nll_r1)) AS risk_r1
  FROM strat GROUP BY endpoint, state, unit_id),
c AS (SELECT *, risk_r0 - risk_r1 AS contribution FROM u),
t AS (SELECT endpoint, state, SUM(n) AS rows, {RISK_SQL} FROM c GROUP BY endpoint, state),
w AS (SELECT *, CAST(units AS DOUBLE) / SUM(units) OVER (PARTITION BY endpoint) AS population_weight FROM t)
SELECT endpoint, state, {FINISH}, ROUND(population_weight, 8) AS population_weight, ROUND(population_weight * delta, 8) AS weighted_delta FROM w""")
def state_risk(spark, folder):
    return risk_rounded(K.state_risk(predictions(spark, folder)))


@query("pair_table", PAIRS_SQL + """SELECT unit_id, endpoint, state, label_r, label_l, ROUND(z_r, 8) AS z_r, ROUND(z_l, 8) AS z_l,
  q1_r, q1_l, q2_r, q2_l, device_r, device_l, ROUND(z_r - z_l, 7) AS asymmetry, ROUND((z_r + z_l) / 2, 7) AS evidence,
  ROUND((label_r - label_l) * (z_r - z_l), 7) AS oriented_margin FROM pair""")
def pair_table(spark, folder):
    wide = K.asymmetry(pair_predictions(spark, folder)).drop("prob_r", "prob_l", "nll_r", "nll_l")
    return rounded(wide, asymmetry=7, evidence=7, oriented_margin=7)


@query("asymmetry_by_state", PAIRS_SQL + """, a AS (SELECT *, z_r - z_l AS a, (label_r - label_l) * (z_r - z_l) AS m, state IN ('10', '01') AS mixed FROM pair)
SELECT endpoint, state, COUNT(*) AS units, ROUND(AVG(a), 7) AS mean_a, ROUND(STDDEV_SAMP(a), 7) AS sd_a,
  ROUND(AVG(m) FILTER (WHERE mixed), 7) AS mean_oriented,
  ROUND(AVG(CASE WHEN m > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) FILTER (WHERE mixed), 7) AS positive_oriented,
  ROUND(QUANTILE_CONT(a, 0.1), 7) AS q10_a, ROUND(QUANTILE_CONT(a, 0.25), 7) AS q25_a, ROUND(QUANTILE_CONT(a, 0.5), 7) AS median_a,
  ROUND(QUANTILE_CONT(a, 0.75), 7) AS q75_a, ROUND(QUANTILE_CONT(a, 0.9), 7) AS q90_a,
  ROUND(QUANTILE_CONT(m, 0.5) FILTER (WHERE mixed), 7) AS median_oriented
FROM a GROUP BY endpoint, state""")
def asymmetry_by_state(spark, folder):
    return rounded(K.asymmetry_summary(pair_predictions(spark, folder)), 7)


@query("quality_level_risk", strata_sql("""SELECT p.*, v.quality, CASE WHEN v.code = 1 THEN 'normal' ELSE 'abnormal' END AS level
  FROM pred p, LATERAL (SELECT 'q1' AS quality, p.q1 AS code UNION ALL SELECT 'q2', p.q2) v WHERE v.code IN (1, 2)""", "endpoint, quality, level"))
def quality_level_risk(spark, folder):
    return risk_rounded(K.quality_level_risk(predictions(spark, folder)))


DIRECTION = """CASE WHEN {0} = 1 AND partner_{0} = 1 THEN 'both_satisfactory' WHEN {0} = 2 AND partner_{0} = 1 THEN 'own_abnormal__fellow_satisfactory'
  WHEN {0} = 1 AND partner_{0} = 2 THEN 'own_satisfactory__fellow_abnormal' WHEN {0} = 2 AND partner_{0} = 2 THEN 'both_abnormal' ELSE 'unevaluable' END"""


@query("directional_risk", strata_sql(
    "SELECT *, 'q1' AS quality, " + DIRECTION.format("q1") + " AS stratum FROM pred UNION ALL SELECT *, 'q2' AS quality, " + DIRECTION.format("q2") + " AS stratum FROM pred",
    "endpoint, quality, stratum"))
def directional_risk(spark, folder):
    return risk_rounded(K.directional_risk(predictions(spark, folder)))


PAIR_DEVICE = """CASE WHEN device = 'A' AND partner_device = 'A' THEN 'A/A' WHEN device = 'B' AND partner_device = 'B' THEN 'B/B' ELSE 'mixed' END"""


@query("device_pair_risk", strata_sql(f"SELECT *, {PAIR_DEVICE} AS device_pair FROM pred", "endpoint, device_pair",
                                      ", CASE WHEN units < 10 THEN 'very_sparse_descriptive' ELSE 'estimable' END AS precision_flag"))
def device_pair_risk(spark, folder):
    return risk_rounded(K.device_risk(predictions(spark, folder), FIRST_DEVICE, SECOND_DEVICE))


@query("same_device_risk", strata_sql(f"SELECT * FROM pred WHERE {PAIR_DEVICE} <> 'mixed'", "endpoint"))
def same_device_risk(spark, folder):
    """Sensitivity without mixed-device pairs."""
    rows = predictions(spark, folder)
    kept = S.device_pair(F.col("device"), F.col("partner_device"), FIRST_DEVICE, SECOND_DEVICE) != "mixed"
    return risk_rounded(K.risk_contrast(rows.filter(kept)))


@query("cohort_table", PAIRS_SQL + """, s AS (SELECT endpoint, COUNT(*) FILTER (WHERE state = '00') AS state_00, COUNT(*) FILTER (WHERE state = '11') AS state_11,
  COUNT(*) FILTER (WHERE state = '10') AS state_10, COUNT(*) FILTER (WHERE state = '01') AS state_01 FROM pair GROUP BY endpoint)
SELECT p.endpoint, COUNT(DISTINCT unit_id) AS units, COUNT(*) AS rows, COUNT(*) FILTER (WHERE label = 1) AS positives, ROUND(AVG(CAST(label AS DOUBLE)), 8) AS prevalence,
  COUNT(*) FILTER (WHERE predicted_class <> label) AS errors, MAX(state_00) AS state_00, MAX(state_11) AS state_11, MAX(state_10) AS state_10, MAX(state_01) AS state_01
FROM pred p JOIN s ON p.endpoint = s.endpoint GROUP BY p.endpoint""")
def cohort_table(spark, folder):
    return rounded(K.cohort_table(predictions(spark, folder)))


@query("confusion_rates", ROWS_SQL + """SELECT endpoint, COUNT(*) FILTER (WHERE label = 1 AND predicted_class = 1) AS true_positive,
  COUNT(*) FILTER (WHERE label = 0 AND predicted_class = 1) AS false_positive, COUNT(*) FILTER (WHERE label = 1 AND predicted_class = 0) AS false_negative,
  COUNT(*) FILTER (WHERE label = 0 AND predicted_class = 0) AS true_negative,
  ROUND(AVG(CAST(predicted_class AS DOUBLE)) FILTER (WHERE label = 1), 8) AS sensitivity,
  ROUND(AVG(CAST(1 - predicted_class AS DOUBLE)) FILTER (WHERE label = 0), 8) AS specificity FROM pred GROUP BY endpoint""")
def confusion_rates(spark, folder):
    return rounded(K.confusion_rates(predictions(spark, folder)))


@query("residual_diagnostics", ROWS_SQL + """, r AS (SELECT endpoint, 'R0' AS model, nll AS observed, nll - predicted_nll_r0 AS residual FROM pred
  UNION ALL SELECT endpoint, 'R1', nll, nll - predicted_nll_r1 FROM pred)
SELECT endpoint, model, COUNT(*) AS rows, ROUND(AVG(residual), 7) AS mean_residual, ROUND(STDDEV_SAMP(residual), 7) AS sd_residual,
  ROUND(AVG(ABS(residual)), 7) AS mae, ROUND(SQRT(AVG(residual * residual)), 7) AS rmse, ROUND(MAX(ABS(residual)), 7) AS max_abs_residual,
  ROUND(CORR(ABS(residual), observed), 7) AS corr_abs_observed, ROUND(QUANTILE_CONT(residual, 0.01), 7) AS q01, ROUND(QUANTILE_CONT(residual, 0.5), 7) AS q50,
  ROUND(QUANTILE_CONT(residual, 0.95), 7) AS q95, ROUND(QUANTILE_CONT(residual, 0.99), 7) AS q99 FROM r GROUP BY endpoint, model""")
def residual_diagnostics(spark, folder):
    return rounded(K.residual_diagnostics(predictions(spark, folder)), 7)


@query("influence", UNITS_SQL + """, t AS (SELECT endpoint, COUNT(*) AS n, SUM(contribution) AS net, SUM(ABS(contribution)) AS total, AVG(contribution) AS m FROM contrib GROUP BY endpoint),
k AS (SELECT c.*, t.n, t.net, t.total, t.m, ROW_NUMBER() OVER (PARTITION BY c.endpoint ORDER BY ABS(contribution) DESC, unit_id) AS by_size,
  ROW_NUMBER() OVER (PARTITION BY c.endpoint ORDER BY observed_loss DESC, unit_id) AS by_loss, GREATEST(1, CEIL(0.01 * n)) AS top FROM contrib c JOIN t ON c.endpoint = t.endpoint)
SELECT endpoint, COUNT(*) AS units, ROUND(MAX(m), 7) AS delta, ROUND(QUANTILE_CONT(contribution, 0.5), 7) AS median_contribution,
  ROUND(QUANTILE_CONT(contribution, 0.05), 7) AS q05_contribution, ROUND(QUANTILE_CONT(contribution, 0.95), 7) AS q95_contribution,
  ROUND(MIN(contribution), 7) AS min_contribution, ROUND(MAX(contribution), 7) AS max_contribution,
  ROUND(AVG(CASE WHEN contribution > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 7) AS positive_fraction,
  ROUND(MAX(ABS((net - contribution) / (n - 1) - m)), 7) AS max_loo_shift,
  ROUND(MAX((net - contribution) / (n - 1)) FILTER (WHERE by_size = 1), 7) AS delta_without_strongest,
  ROUND(SUM(ABS(contribution)) FILTER (WHERE by_size <= top) / MAX(total), 7) AS top1pct_abs_share,
  ROUND(SUM(contribution) FILTER (WHERE by_loss <= top) / MAX(net), 7) AS top1pct_loss_net_share,
  ROUND(MAX(contribution) / MAX(net), 7) AS largest_positive_share, ROUND(MIN(contribution) / MAX(net), 7) AS largest_negative_share
FROM k GROUP BY endpoint""")
def influence(spark, folder):
    return rounded(K.influence(K.unit_risks(predictions(spark, folder))), 7)


@query("loss_tail", UNITS_SQL + """, q AS (SELECT endpoint, QUANTILE_CONT(observed_loss, 0.5) AS c0, QUANTILE_CONT(observed_loss, 0.9) AS c1,
  QUANTILE_CONT(observed_loss, 0.95) AS c2, QUANTILE_CONT(observed_loss, 0.99) AS c3, SUM(contribution) AS net FROM contrib GROUP BY endpoint),
b AS (SELECT endpoint, net, '0-50%' AS band, CAST(NULL AS DOUBLE) AS lo, c0 AS hi FROM q UNION ALL SELECT endpoint, net, '50-90%', c0, c1 FROM q
  UNION ALL SELECT endpoint, net, '90-95%', c1, c2 FROM q UNION ALL SELECT endpoint, net, '95-99%', c2, c3 FROM q UNION ALL SELECT endpoint, net, '99-100%', c3, NULL FROM q)
SELECT b.endpoint, band, ROUND(MAX(lo), 7) AS lower_exclusive, ROUND(MAX(hi), 7) AS upper_inclusive, COUNT(c.unit_id) AS units, ROUND(AVG(observed_loss), 7) AS mean_observed,
  ROUND(AVG(risk_r0), 7) AS risk_r0, ROUND(AVG(risk_r1), 7) AS risk_r1, ROUND(AVG(contribution), 7) AS delta, ROUND(COALESCE(SUM(contribution), 0) / MAX(net), 7) AS net_share
FROM b LEFT JOIN contrib c ON b.endpoint = c.endpoint AND (lo IS NULL OR observed_loss > lo) AND (hi IS NULL OR observed_loss <= hi) GROUP BY b.endpoint, band""")
def loss_tail(spark, folder):
    return rounded(K.loss_tail(K.unit_risks(predictions(spark, folder))), 7)


@query("contribution_histogram", UNITS_SQL + """, q AS (SELECT endpoint, QUANTILE_CONT(contribution, 0.01) AS ql, QUANTILE_CONT(contribution, 0.99) AS qh FROM contrib GROUP BY endpoint),
p AS (SELECT c.*, ql, qh, contribution >= ql AND contribution <= qh AS inside FROM contrib c JOIN q ON c.endpoint = q.endpoint),
s AS (SELECT endpoint, MIN(contribution) FILTER (WHERE inside) AS lo, MAX(contribution) FILTER (WHERE inside) AS hi, COUNT(*) FILTER (WHERE contribution < ql) AS below,
  COUNT(*) FILTER (WHERE contribution > qh) AS above FROM p GROUP BY endpoint),
h AS (SELECT p.endpoint, LEAST(CAST(FLOOR((contribution - lo) / ((hi - lo) / 36)) AS INTEGER), 35) AS bin, COUNT(*) AS units FROM p JOIN s ON p.endpoint = s.endpoint WHERE inside GROUP BY 1, 2),
g AS (SELECT s.*, CAST(r AS INTEGER) AS bin FROM s, range(36) t(r))
SELECT g.endpoint, g.bin, below, above, ROUND(lo + (hi - lo) / 36 * g.bin, 7) AS bin_low, ROUND(lo + (hi - lo) / 36 * (g.bin + 1), 7) AS bin_high, COALESCE(h.units, 0) AS units
FROM g LEFT JOIN h ON g.endpoint = h.endpoint AND g.bin = h.bin""")
def contribution_histogram(spark, folder):
    return rounded(K.contribution_histogram(K.unit_risks(predictions(spark, folder))), 7)


PATTERN = """CASE WHEN {0}_r IN (1, 2) AND {0}_l IN (1, 2) THEN 'R_' || CASE {0}_r WHEN 1 THEN 'satisfactory' ELSE 'abnormal' END
  || '__L_' || CASE {0}_l WHEN 1 THEN 'satisfactory' ELSE 'abnormal' END ELSE 'unevaluable' END"""


@query("quality_patterns", PAIRS_SQL + f""", one AS (SELECT * FROM pair WHERE endpoint = 'discount'),
l AS (SELECT 'q1' AS quality, {PATTERN.format('q1')} AS pattern, q1_r AS r, q1_l AS l FROM one UNION ALL SELECT 'q2', {PATTERN.format('q2')}, q2_r, q2_l FROM one),
t AS (SELECT quality, COUNT(*) AS n, COUNT(*) FILTER (WHERE r = 2) + COUNT(*) FILTER (WHERE l = 2) AS abnormal_rows,
  COUNT(*) FILTER (WHERE r NOT IN (1, 2)) + COUNT(*) FILTER (WHERE l NOT IN (1, 2)) AS unevaluable_rows FROM l GROUP BY quality)
SELECT l.quality, pattern, COUNT(*) AS units, ROUND(100.0 * COUNT(*) / MAX(n), 8) AS percent_units, MAX(abnormal_rows) AS abnormal_rows, MAX(unevaluable_rows) AS unevaluable_rows
FROM l JOIN t ON l.quality = t.quality GROUP BY l.quality, pattern""")
def quality_patterns(spark, folder):
    pairs = pair_predictions(spark, folder).filter(F.col("endpoint") == ENDPOINTS[0])  # quality is the same for every endpoint
    return rounded(K.quality_patterns(pairs))


@query("complete_pairs", PAIRS_SQL + """SELECT endpoint, COUNT(*) AS units, COUNT(*) FILTER (WHERE q2_r IN (1, 2) AND q2_l IN (1, 2)) AS complete_units FROM pair GROUP BY endpoint""")
def complete_pairs(spark, folder):
    return K.complete_pairs(pair_predictions(spark, folder))


# -- ranking metrics -------------------------------------------------------------------------------------------------

RANKING_SQL = """, g AS (SELECT {keys}, {score} AS s, COUNT(*) FILTER (WHERE {y} = 1) AS p, COUNT(*) FILTER (WHERE {y} = 0) AS q FROM {rows} GROUP BY {keys}, {score}),
w AS (SELECT *, SUM(p) OVER o AS tp, SUM(q) OVER o AS fp FROM g WINDOW o AS (PARTITION BY {keys} ORDER BY s DESC)),
a AS (SELECT {keys}, CAST(SUM(p) AS BIGINT) AS positives, CAST(SUM(q) AS BIGINT) AS negatives, SUM(CAST(q AS DOUBLE) * (tp - p / 2.0)) AS area, SUM(CAST(p AS DOUBLE) * tp / (tp + fp)) AS steps FROM w GROUP BY {keys})
"""


@query("ranking_metrics", ROWS_SQL + RANKING_SQL.format(keys="endpoint", score="prob", y="label", rows="pred") +
       "SELECT endpoint, positives, negatives, ROUND(area / positives / negatives, 8) AS auroc, ROUND(steps / positives, 8) AS average_precision FROM a")
def ranking_metrics(spark, folder):
    return rounded(R.binary_ranking(predictions(spark, folder), F.col("label"), "prob"))


ERROR = "(CASE WHEN predicted_class <> label THEN 1 ELSE 0 END)"


def error_column() -> Column:
    return (F.col("predicted_class") != F.col("label")).cast("int")


@query("error_detection", ROWS_SQL + RANKING_SQL.format(keys="endpoint", score="predicted_nll_r1", y=ERROR, rows="pred") + """,
cv AS (SELECT endpoint, ROW_NUMBER() OVER o AS k, CAST(SUM(""" + ERROR + """) OVER o AS DOUBLE) AS e FROM pred WINDOW o AS (PARTITION BY endpoint ORDER BY predicted_nll_r1, unit_id, side ROWS UNBOUNDED PRECEDING)),
n AS (SELECT endpoint, COUNT(*) AS n, CAST(MAX(e) AS BIGINT) AS errors, AVG(e / k) AS aurc FROM cv GROUP BY endpoint),
sel AS (SELECT cv.endpoint, MAX(e / k) FILTER (WHERE k = GREATEST(1, CEIL(0.9 * n))) AS s90, MAX(e / k) FILTER (WHERE k = GREATEST(1, CEIL(0.8 * n))) AS s80,
  MAX(e / k) FILTER (WHERE k = GREATEST(1, CEIL(0.7 * n))) AS s70 FROM cv JOIN n ON cv.endpoint = n.endpoint GROUP BY cv.endpoint)
SELECT a.endpoint, errors, ROUND(aurc, 7) AS aurc, ROUND(s90, 7) AS selective_risk_90, ROUND(s80, 7) AS selective_risk_80, ROUND(s70, 7) AS selective_risk_70,
  ROUND(area / positives / negatives, 7) AS auroc, ROUND(steps / positives, 7) AS average_precision FROM a JOIN n ON a.endpoint = n.endpoint JOIN sel ON a.endpoint = sel.endpoint""")
def error_detection(spark, folder):
    rows = cut(predictions(spark, folder).select("endpoint", "unit_id", "side", "label", "predicted_class", "predicted_nll_r1"))
    curve = R.risk_coverage(rows, error_column(), "predicted_nll_r1")
    detect = R.binary_ranking(rows.withColumn("error", error_column()), F.col("error"), "predicted_nll_r1").drop("positives", "negatives")
    return rounded(R.coverage_summary(curve).join(detect, "endpoint"), 7)


@query("risk_coverage_curve", ROWS_SQL + "SELECT endpoint, unit_id, side, ROW_NUMBER() OVER o AS retained, CAST(SUM(" + ERROR + """) OVER o AS BIGINT) AS errors,
  ROUND(CAST(SUM(""" + ERROR + """) OVER o AS DOUBLE) / ROW_NUMBER() OVER o, 8) AS cumulative_risk
FROM pred WINDOW o AS (PARTITION BY endpoint ORDER BY predicted_nll_r0, unit_id, side ROWS UNBOUNDED PRECEDING)""")
def risk_coverage_curve(spark, folder):
    return rounded(R.risk_coverage(predictions(spark, folder), error_column(), "predicted_nll_r0").drop("group_rows"))


@query("spearman", ROWS_SQL + """, r AS (SELECT endpoint, """ + ", ".join(
    f"RANK() OVER (PARTITION BY endpoint ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY endpoint, {c}) - 1) / 2.0 AS {n}"
    for c, n in (("nll", "o"), ("predicted_nll_r0", "p0"), ("predicted_nll_r1", "p1"))) + """ FROM pred)
SELECT endpoint, ROUND(CORR(o, p0), 7) AS spearman_r0, ROUND(CORR(o, p1), 7) AS spearman_r1, ROUND(CORR(o, p1) - CORR(o, p0), 7) AS difference FROM r GROUP BY endpoint""")
def spearman(spark, folder):
    rows = cut(predictions(spark, folder).select("endpoint", "unit_id", "side", "nll", "predicted_nll_r0", "predicted_nll_r1"))
    table = R.spearman(rows, "nll", ["predicted_nll_r0", "predicted_nll_r1"])
    return rounded(table.withColumn("difference", F.col("spearman_r1") - F.col("spearman_r0")), 7)


EDGES_SQL = ", edge AS (SELECT endpoint, [" + ", ".join(f"QUANTILE_CONT(prob, {i / 10})" for i in range(11)) + """] AS edges FROM pred GROUP BY endpoint),
slot AS (SELECT p.endpoint, p.prob, p.label, LEN(LIST_FILTER(edges[2:10], lambda e: e < p.prob)) AS bin FROM pred p JOIN edge ON p.endpoint = edge.endpoint),
cnt AS (SELECT endpoint, bin, COUNT(*) AS n, AVG(prob) AS mp, AVG(CAST(label AS DOUBLE)) AS obs FROM slot GROUP BY endpoint, bin),
bins AS (SELECT e.endpoint, CAST(r AS INTEGER) AS bin, COALESCE(n, 0) AS count, edges[r + 1] AS lower_edge, edges[r + 2] AS upper_edge, mp, obs
  FROM edge e CROSS JOIN range(10) t(r) LEFT JOIN cnt ON cnt.endpoint = e.endpoint AND cnt.bin = r)
"""


@query("reliability_bins", ROWS_SQL + EDGES_SQL + """SELECT endpoint, bin, count, ROUND(lower_edge, 7) AS lower_edge, ROUND(upper_edge, 7) AS upper_edge,
  ROUND(mp, 7) AS mean_probability, ROUND(obs, 7) AS observed_rate FROM bins""")
def reliability_bins(spark, folder):
    rows = cut(predictions(spark, folder).select("endpoint", "prob", "label"))
    return rounded(R.reliability_bins(rows, R.equal_frequency_edges(rows)), 7)


ECE_SQL = """SELECT endpoint, CAST(SUM(count) AS BIGINT) AS rows, MIN(count) AS smallest_bin,
  ROUND(CASE WHEN COUNT(*) FILTER (WHERE lower_edge = upper_edge) = 0 {thin} THEN SUM(count * ABS(mp - obs)) / SUM(count) END, 7) AS ece,
  CASE WHEN COUNT(*) FILTER (WHERE lower_edge = upper_edge) > 0 THEN 'duplicate quantile edges' {why} END AS reason FROM {bins} GROUP BY endpoint"""


@query("equal_frequency_ece", ROWS_SQL + EDGES_SQL + ECE_SQL.format(thin="", why="", bins="bins"))
def equal_frequency_ece(spark, folder):
    rows = cut(predictions(spark, folder).select("endpoint", "prob", "label"))
    return rounded(R.calibration_error(R.reliability_bins(rows, R.equal_frequency_edges(rows))), 7)


@query("fixed_edge_ece", ROWS_SQL + EDGES_SQL.replace("FROM pred GROUP", "FROM pred WHERE device = 'A' GROUP").replace("FROM pred p JOIN", "FROM (SELECT * FROM pred WHERE device = 'B') p JOIN")
       + ECE_SQL.format(thin="AND MIN(count) >= 30", why="WHEN MIN(count) < 30 THEN 'bin below minimum count'", bins="bins"))
def fixed_edge_ece(spark, folder):
    """Edges frozen on one subset (device A), applied to another (device B)."""
    rows = predictions(spark, folder)
    edges = R.equal_frequency_edges(rows.filter(F.col("device") == FIRST_DEVICE))
    return rounded(R.calibration_error(R.reliability_bins(rows.filter(F.col("device") == SECOND_DEVICE), edges), min_count=30), 7)


CASES = {"highest_loss": ("observed_loss", True), "largest_improvement": ("contribution", True), "largest_deterioration": ("contribution", False)}


@query("case_audit", UNITS_SQL + ", k AS (" + " UNION ALL ".join(
    f"SELECT *, '{rule}' AS rule, ROW_NUMBER() OVER (PARTITION BY endpoint ORDER BY {c} {'DESC' if d else 'ASC'}, CAST(unit_id AS VARCHAR)) AS rank FROM contrib"
    for rule, (c, d) in CASES.items()) + """)
SELECT k.endpoint, rule, CAST(rank AS INTEGER) AS rank, SHA256('CASE_AUDIT|' || k.unit_id) AS unit_key, p.state, ROUND(observed_loss, 10) AS observed_loss, ROUND(risk_r0, 8) AS risk_r0, ROUND(risk_r1, 8) AS risk_r1,
  ROUND(contribution, 8) AS contribution FROM k JOIN pair p ON k.unit_id = p.unit_id AND k.endpoint = p.endpoint WHERE rank <= 10""")
def case_audit(spark, folder):
    rows = predictions(spark, folder)
    state = F.when(F.col("side") == 1, S.pair_state(F.col("label"), F.col("partner_label"))).otherwise(S.pair_state(F.col("partner_label"), F.col("label")))
    units = K.unit_risks(rows.withColumn("state", state), "nll", ["endpoint", "state"])  # a unit has one state
    return rounded(R.top_units(units.drop("unit_rows"), CASES), observed_loss=10)


@query("out_of_sample_r2", ROWS_SQL + """, m AS (SELECT endpoint, AVG(nll) AS mu FROM pred GROUP BY endpoint)
SELECT p.endpoint, ROUND(1 - AVG((nll - predicted_nll_r0) * (nll - predicted_nll_r0)) / VAR_POP(nll), 7) AS r2_r0,
  ROUND(1 - AVG((nll - predicted_nll_r1) * (nll - predicted_nll_r1)) / VAR_POP(nll), 7) AS r2_r1 FROM pred p GROUP BY p.endpoint""")
def out_of_sample_r2(spark, folder):
    y = F.col("nll")
    return rounded(predictions(spark, folder).groupBy("endpoint").agg(*[
        (F.lit(1.0) - F.avg(K.square(y - F.col(f"predicted_nll_{m}"))) / F.var_pop(y)).alias(f"r2_{m}") for m in ("r0", "r1")]), 7)


NLL_AT = "AVG(-(label * LN(GREATEST({0}, LEAST(1 - {0}, prob))) + (1 - label) * LN(1 - GREATEST({0}, LEAST(1 - {0}, prob)))))"


@query("clip_sensitivity", ROWS_SQL + " UNION ALL ".join(
    f"SELECT endpoint, CAST({e} AS DOUBLE) AS clip, ROUND({NLL_AT.format(e)}, 8) AS nll, COUNT(*) FILTER (WHERE prob < {e} OR prob > 1 - {e}) AS clipped FROM pred GROUP BY endpoint"
    for e in ("1e-5", "1e-6", "1e-7")))
def clip_sensitivity(spark, folder):
    y, p = F.col("label").cast("double"), F.col("prob")
    long = predictions(spark, folder).select("endpoint", F.explode(F.array(*[
        F.struct(F.lit(e).alias("clip"), S.binary_nll(y, p, e).alias("nll"), S.is_clipped(p, e).alias("hit"))
        for e in (S.PRIMARY_CLIP, *S.SENSITIVITY_CLIPS)])).alias("_c")).select("endpoint", "_c.*")
    return rounded(long.groupBy("endpoint", "clip").agg(F.avg("nll").alias("nll"), F.count_if("hit").alias("clipped")), 8, clip=12)


@query("partner_rows", ROWS_SQL + """SELECT unit_id, side, endpoint, device, q1, q2, label, ROUND(z, 8) AS z, partner_q1, partner_q2, partner_label, ROUND(partner_z, 8) AS partner_z FROM pred""")
def partner_rows(spark, folder):
    rows = predictions(spark, folder).select("unit_id", "side", "endpoint", "device", "q1", "q2", "label", "z", "partner_q1", "partner_q2", "partner_label", "partner_z")
    return rounded(rows)
