"""Cohort, holdout, folds and balance over clean pairs of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import cohort as C
from dyadlab.operators.pairs import UNIT
from dyadlab.plans.audit_queries import LABELS, PAIR, SRC, source
from dyadlab.plans.registry import query
from dyadlab.plans.risk_queries import rounded
from dyadlab.session import cut

N = S.number
HOLDOUT_SEED, OUTER_SEED, INNER_SEED, FRACTION = 20260829, 20260901, 20260902, 0.25


def cohort_rows(spark, folder):
    """Lines 1 and 2 with the device as a number (numbers keep the pairing a hash aggregation)."""
    rows = source(spark, folder).filter(F.col("side").isin(1, 2))
    return rows.select(UNIT, "side", F.when(F.col("device") == "A", 1).otherwise(2).alias("dev"), *[S.lenient_number(F.col(c)).alias(c) for c in (*LABELS, "q1", "q2", "age", "sex")])


def cohort(spark, folder):
    """Clean pairs with state, device pair, quality patterns, sex and age band."""
    wide = C.clean_pairs(cohort_rows(spark, folder), LABELS, ["dev", "q1", "q2", "age", "sex"])
    col = F.col
    device = lambda s: F.when(col(f"dev_{s}") == 1, "A").otherwise("B")
    sex = lambda s: col(f"sex_{s}").cast("int").cast("string")
    age = S.reconciled_number(col("age_r"), col("age_l"))
    return wide.select(
        UNIT, *[S.pair_state(col(f"{y}_r"), col(f"{y}_l")).alias("state" if y == "y1" else f"{y}_state") for y in LABELS],
        S.device_pair(device("r"), device("l"), "A", "B").alias("device_pair"),
        S.quality_pattern_by_side(col("q1_r"), col("q1_l")).alias("q1_pair"), S.quality_pattern_by_side(col("q2_r"), col("q2_l")).alias("q2_pair"),
        S.reconciled_code(sex("r"), sex("l"), {"1": "male", "2": "female"}, "missing_or_unexpected").alias("sex"), age.alias("age"),
        S.band(age, S.AGE_EDGES, S.AGE_LABELS, S.AGE_MISSING).alias("age_bin"))


def word(q):
    return f"CASE {q} WHEN 1 THEN 'normal' WHEN 2 THEN 'abnormal' ELSE 'unevaluable' END"


COHORT = PAIR + ", co AS (SELECT unit_id, " + ", ".join(
    f"CAST(CAST({y}_r AS INTEGER) AS VARCHAR) || CAST(CAST({y}_l AS INTEGER) AS VARCHAR) AS {'state' if y == 'y1' else y + '_state'}" for y in LABELS) + """,
  CASE WHEN device_r = 'A' AND device_l = 'A' THEN 'A/A' WHEN device_r = 'B' AND device_l = 'B' THEN 'B/B' ELSE 'mixed' END AS device_pair,
  'R_' || """ + word("q1_r") + " || '__L_' || " + word("q1_l") + " AS q1_pair, 'R_' || " + word("q2_r") + " || '__L_' || " + word("q2_l") + """ AS q2_pair,
  CASE WHEN sex_r IS DISTINCT FROM sex_l THEN 'inconsistent' WHEN sex_r = 1 THEN 'male' WHEN sex_r = 2 THEN 'female' ELSE 'missing_or_unexpected' END AS sex,
  CASE WHEN age_r IS NOT DISTINCT FROM age_l THEN age_r END AS age,
  CASE WHEN age_r IS DISTINCT FROM age_l OR age_r IS NULL THEN 'missing_or_inconsistent' WHEN age_r < 40 THEN 'under_40' WHEN age_r < 60 THEN '40_to_59' WHEN age_r < 80 THEN '60_to_79' ELSE '80_or_older' END AS age_bin
  FROM pr WHERE """ + " AND ".join(f"{y}_{s} IN (0, 1)" for y in LABELS for s in "rl") + ")"


@query("clean_cohort", COHORT + " SELECT * FROM co")
def clean_cohort(spark, folder):
    return cohort(spark, folder)


@query("exclusion_counts", SRC + """, g AS (SELECT unit_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE side = 1) AS r, COUNT(*) FILTER (WHERE side = 2) AS l, COUNT(DISTINCT side) AS sides, COUNT(DISTINCT device) AS devices,
  COUNT(*) FILTER (WHERE TRY_CAST(y1 AS DOUBLE) IN (0, 1) AND TRY_CAST(y2 AS DOUBLE) IN (0, 1) AND TRY_CAST(y3 AS DOUBLE) IN (0, 1)) AS b, COUNT(*) FILTER (WHERE COALESCE(TRY_CAST(q2 AS DOUBLE), 9) NOT IN (1, 2)) AS q FROM src GROUP BY unit_id)
SELECT CAST(SUM(n) AS BIGINT) AS all_rows, COUNT(*) AS all_units, COUNT(*) FILTER (WHERE n = 2 AND r = 1 AND l = 1 AND b = 2) AS clean_units, COUNT(*) FILTER (WHERE NOT (n = 2 AND r = 1 AND l = 1 AND b = 2)) AS other_units,
  COUNT(*) FILTER (WHERE n = 1) AS single_row, COUNT(*) FILTER (WHERE sides = 1) AS single_side, COUNT(*) FILTER (WHERE sides < n) AS duplicate_side, COUNT(*) FILTER (WHERE n > 2) AS over_two_rows,
  COUNT(*) FILTER (WHERE devices > 1) AS several_devices, CAST(SUM(q) AS BIGINT) AS invalid_quality_rows FROM g""")
def exclusion_counts(spark, folder):
    return C.exclusion_counts(source(spark, folder), LABELS, "q2", "device")


HAMILTON = COHORT + """, cells AS (SELECT device_pair, state, COUNT(*) AS n FROM co GROUP BY device_pair, state),
tops AS (SELECT device_pair, CAST(SUM(n) AS BIGINT) AS n FROM cells GROUP BY device_pair), goal AS (SELECT CAST(ROUND_EVEN(0.25 * SUM(n), 0) AS BIGINT) AS g, CAST(SUM(n) AS BIGINT) AS total FROM tops),
tb AS (SELECT device_pair, n, n * g // total AS base, n * g % total AS rest, g FROM tops, goal),
tq AS (SELECT device_pair, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rest DESC, n, device_pair) <= g - SUM(base) OVER () THEN 1 ELSE 0 END AS goal FROM tb),
cb AS (SELECT c.device_pair, c.state, c.n, goal, c.n * goal // t.n AS base, c.n * goal % t.n AS rest FROM cells c JOIN tops t ON c.device_pair = t.device_pair JOIN tq ON c.device_pair = tq.device_pair),
quotas AS (SELECT device_pair, state, n, CAST(base + CASE WHEN ROW_NUMBER() OVER (PARTITION BY device_pair ORDER BY rest DESC, n, state) <= goal - SUM(base) OVER (PARTITION BY device_pair) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM cb)
"""


@query("holdout_quotas", HAMILTON + "SELECT device_pair, state, n, quota FROM quotas")
def holdout_quotas(spark, folder):
    return C.stratum_quotas(cohort(spark, folder), "device_pair", "state", FRACTION)


ASSIGNED = HAMILTON + f""", h AS (SELECT co.*, ROW_NUMBER() OVER (PARTITION BY device_pair, state ORDER BY SHA256('{HOLDOUT_SEED}|' || unit_id), unit_id) AS k FROM co),
assigned AS (SELECT h.*, CASE WHEN k <= quota THEN 'final_holdout' ELSE 'development' END AS "partition" FROM h JOIN quotas q ON h.device_pair = q.device_pair AND h.state = q.state)
"""


def assigned(spark, folder):
    return C.assign_holdout(cut(cohort(spark, folder)), "device_pair", "state", FRACTION, HOLDOUT_SEED)


@query("holdout_assignment", ASSIGNED + 'SELECT unit_id, device_pair, state, "partition" FROM assigned')
def holdout_assignment(spark, folder):
    return assigned(spark, folder).select("unit_id", "device_pair", "state", "partition")


VARIABLES, ALLOCATION = ["state", "y2_state", "y3_state", "device_pair", "q1_pair", "q2_pair", "sex", "age_bin"], ["state", "device_pair"]


@query("balance_table", ASSIGNED + ", l AS (" + " UNION ALL ".join(f"SELECT \"partition\" AS p, '{v}' AS variable, {v} AS level FROM assigned" for v in VARIABLES) + """),
t AS (SELECT COUNT(*) FILTER (WHERE "partition" = 'development') AS d, COUNT(*) FILTER (WHERE "partition" = 'final_holdout') AS h FROM assigned),
c AS (SELECT variable, level, COUNT(*) FILTER (WHERE p = 'development') AS development_n, COUNT(*) FILTER (WHERE p = 'final_holdout') AS holdout_n FROM l GROUP BY variable, level)
SELECT variable, level, development_n, PRINTF('%.8f', CAST(development_n AS DOUBLE) / d) AS development_fraction, holdout_n, PRINTF('%.8f', CAST(holdout_n AS DOUBLE) / h) AS holdout_fraction,
  PRINTF('%.8f', CAST(holdout_n AS DOUBLE) / h - CAST(development_n AS DOUBLE) / d) AS difference, CASE WHEN variable IN ('state', 'device_pair') THEN 'allocation' ELSE 'descriptive_balance_only' END AS role FROM c, t""")
def balance_table(spark, folder):
    return C.balance_table(assigned(spark, folder), VARIABLES, ALLOCATION)


@query("age_by_partition", ASSIGNED + 'SELECT "partition", COUNT(age) AS evaluable, ROUND(AVG(age), 6) AS mean, ROUND(QUANTILE_CONT(age, 0.5), 6) AS median FROM assigned GROUP BY "partition"')
def age_by_partition(spark, folder):
    return rounded(C.number_summary(assigned(spark, folder), "age"), 6)


DIGEST = "('0x' || SUBSTR(SHA256(unit_id || '|' || {0}), 1, 15))::BIGINT"


@query("manifest_digest", ASSIGNED + f"""SELECT 'manifest' AS artefact, COUNT(*) AS rows, CAST(SUM({DIGEST.format('"partition"')}) AS VARCHAR) AS content_hash FROM assigned
UNION ALL SELECT 'cohort', COUNT(*), CAST(SUM({DIGEST.format('state')}) AS VARCHAR) FROM assigned""")
def manifest_digest(spark, folder):
    units = assigned(spark, folder)
    return C.content_hash(units, [UNIT, "partition"]).withColumn("artefact", F.lit("manifest")).unionByName(
        C.content_hash(units, [UNIT, "state"]).withColumn("artefact", F.lit("cohort")))


FOLDS = COHORT + f""", st AS (SELECT state, COALESCE(SUM(COUNT(*)) OVER (ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM co GROUP BY state),
ou AS (SELECT co.unit_id, co.state, CAST((start + ROW_NUMBER() OVER (PARTITION BY co.state ORDER BY SHA256('{OUTER_SEED}|' || unit_id), unit_id) - 1) % 5 AS INTEGER) AS outer_fold FROM co JOIN st ON co.state = st.state),
tr AS (SELECT ou.*, CAST(r AS INTEGER) AS assessed FROM ou, range(5) t(r)),
s2 AS (SELECT assessed, state, COALESCE(SUM(COUNT(*)) OVER (PARTITION BY assessed ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tr WHERE assessed <> outer_fold GROUP BY assessed, state),
inn AS (SELECT tr.unit_id, tr.assessed, CAST((start + ROW_NUMBER() OVER (PARTITION BY tr.assessed, tr.state ORDER BY SHA256(CAST({INNER_SEED} + tr.assessed AS VARCHAR) || '|' || unit_id), unit_id) - 1) % 3 AS INTEGER) AS inner_fold
  FROM tr JOIN s2 ON tr.assessed = s2.assessed AND tr.state = s2.state WHERE tr.assessed <> outer_fold)
"""


@query("outer_folds", FOLDS + "SELECT * FROM ou")
def outer_folds(spark, folder):
    return C.outer_folds(cohort(spark, folder), seed=OUTER_SEED)


@query("inner_folds", FOLDS + "SELECT inn.unit_id, state, inn.assessed, inner_fold FROM inn JOIN ou ON inn.unit_id = ou.unit_id")
def inner_folds(spark, folder):
    return C.inner_folds(C.outer_folds(cohort(spark, folder), seed=OUTER_SEED), seed=INNER_SEED)


@query("fold_manifest", FOLDS + "SELECT tr.unit_id, tr.state, tr.outer_fold, tr.assessed, inn.inner_fold FROM tr LEFT JOIN inn ON tr.unit_id = inn.unit_id AND tr.assessed = inn.assessed")
def fold_manifest(spark, folder):
    return C.fold_manifest(cohort(spark, folder), outer_seed=OUTER_SEED, inner_seed=INNER_SEED)


@query("fold_violations", FOLDS + """SELECT 'fold lacks a state' AS rule, CAST(outer_fold AS VARCHAR) AS detail FROM ou GROUP BY outer_fold HAVING COUNT(DISTINCT state) FILTER (WHERE state IN ('00', '11', '10', '01')) < 4
UNION ALL SELECT 'number of folds', CAST(COUNT(DISTINCT outer_fold) AS VARCHAR) FROM ou HAVING COUNT(DISTINCT outer_fold) <> 6 UNION ALL SELECT 'unit repeated', CAST(unit_id AS VARCHAR) FROM ou GROUP BY unit_id HAVING COUNT(*) > 1""")
def fold_violations(spark, folder):
    """Checked against one fold too many, so that the rule on their number must fire."""
    return C.fold_violations(C.outer_folds(cohort(spark, folder), seed=OUTER_SEED), "outer_fold", 6)


@query("unrelated_partner", COHORT + """, d AS (SELECT unit_id, state, age_bin, SHA256('77|' || unit_id) AS digest FROM co), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY state ORDER BY digest, unit_id) AS k, COUNT(*) OVER (PARTITION BY state) AS n FROM d)
SELECT a.unit_id, a.state, a.age_bin, b.unit_id AS control_unit, b.age_bin AS control_age_bin FROM r a JOIN r b ON a.state = b.state AND b.k = a.k % a.n + 1""")
def unrelated_partner(spark, folder):
    return C.unrelated_partner(cohort(spark, folder), "state", ["age_bin"], 77)
