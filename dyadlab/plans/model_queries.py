"""Fitted models: heads, calibrators, loss models, nested stack, robust regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import calibrate as Q
from dyadlab.operators import heads as H
from dyadlab.operators import lossmodel as L
from dyadlab.operators import nested as T
from dyadlab.operators import ranking as R
from dyadlab.operators import resample as B
from dyadlab.operators import risk as K
from dyadlab.operators import robust as G
from dyadlab.operators.pairs import UNIT
from dyadlab.plans.registry import query, table
from dyadlab.plans.risk_queries import rounded
from dyadlab.plans.views import ENDPOINTS, FIRST_DEVICE, PAIRS_SQL, ROWS_SQL, SECOND_DEVICE, pair_predictions, predictions
from dyadlab.session import cut

N = S.number
PLAN = T.Plan(endpoints=("low_label", "odd_label"), second_device="B")


def embedding_pairs(spark, folder) -> DataFrame:
    """Vectors 2k and 2k + 1 are the sides of unit k; two endpoints; codes and devices follow from the unit number."""
    rows = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias(UNIT), (F.col("vec_id") % 2 + 1).cast("int").alias("side"), F.col("embedding").cast("array<double>").alias("x"),
        F.array((F.col("label") < 4).cast("int"), (F.col("label") % 2).cast("int")).alias("y"))
    unit, side = F.col(UNIT), F.col("side")
    rows = rows.withColumns({
        "q1": F.when((unit + side) % 5 == 0, 2).otherwise(1), "q2": F.when((unit + side) % 7 == 0, 2).when((unit + side) % 11 == 0, 0).otherwise(1),
        "device": F.when((unit % 3 == 0) | ((unit % 10 == 1) & (side == 2)), "B").otherwise("A")})
    pick = lambda c, s: F.first(F.when(side == s, F.col(c)), ignorenulls=True)
    wide = rows.groupBy(UNIT).agg(
        F.count("*").alias("_n"), F.count_if(side == 1).alias("_r"), *[pick(c, i + 1).alias(f"{c}_{s}") for c in ("x", "y", "q1", "q2", "device") for i, s in enumerate("rl")])
    return wide.filter("_n = 2 AND _r = 1").drop("_n", "_r")


def nested(spark, folder):
    return T.run_nested(T.with_folds(embedding_pairs(spark, folder), PLAN), PLAN)


@query("nested_predictions")
def nested_predictions(spark, folder):
    return rounded(nested(spark, folder).predictions, 6)


@query("nested_selection")
def nested_selection(spark, folder):
    return rounded(nested(spark, folder).candidates, 6)


@query("nested_alpha_selection")
def nested_alpha_selection(spark, folder):
    return rounded(nested(spark, folder).alphas, 6)


@query("frozen_holdout_scores")
def frozen_holdout_scores(spark, folder):
    """Hold a stratified quarter out, fit the whole stack on the rest, score the held-out units once."""
    from dyadlab.operators.cohort import HOLDOUT, assign_holdout

    pairs = cut(embedding_pairs(spark, folder))
    units = pairs.select(UNIT, S.pair_state(F.col("y_r")[0], F.col("y_l")[0]).alias("state"), S.device_pair(F.col("device_r"), F.col("device_l"), "A", "B").alias("device_pair"))
    placed = pairs.join(assign_holdout(units, "device_pair", "state", 0.25, 20260829).select(UNIT, "partition"), UNIT)
    development = T.with_folds(placed.filter(F.col("partition") != HOLDOUT).drop("partition"), PLAN)
    stack = T.fit_final(T.run_nested(development, PLAN), PLAN)
    return rounded(T.score_frozen(placed.filter(F.col("partition") == HOLDOUT).drop("partition"), stack, PLAN), 6)


@query("final_choices")
def final_choices(spark, folder):
    return T.final_choices(nested(spark, folder), PLAN)


@query("schema_contract")
def schema_contract(spark, folder):
    return T.schema_contract(T.fit_final(nested(spark, folder), PLAN).losses)


@query("subset_knots", PAIRS_SQL + """, s AS (SELECT p.endpoint, CAST(l.x AS INTEGER) - 1 AS left_out, UNNEST([p.z_r, p.z_l]) AS z FROM pair p JOIN range(4) l(x) ON p.unit_id % 3 <> l.x - 1)
SELECT endpoint, left_out, COUNT(*) AS values, ROUND(QUANTILE_CONT(z, 0.0), 8) AS k0, ROUND(QUANTILE_CONT(z, 0.25), 8) AS k1, ROUND(QUANTILE_CONT(z, 0.5), 8) AS k2, ROUND(QUANTILE_CONT(z, 0.75), 8) AS k3, ROUND(QUANTILE_CONT(z, 1.0), 8) AS k4
FROM s GROUP BY endpoint, left_out""")
def subset_knots(spark, folder):
    """Spline knots of the logits of each endpoint on all units and with each third of the units left out, in shared passes."""
    place = (F.array_position(F.array(*map(F.lit, ENDPOINTS)), F.col("endpoint")) - 1).cast("int")
    pairs = cut(pair_predictions(spark, folder).select("endpoint", place.alias("code"), F.pmod("unit_id", F.lit(3)).cast("int").alias("fold"), "z_r", "z_l"))

    def subsets(c):
        return {int(e) * 4 + left + 1: (c["code"] == e) & (c["fold"] != left) for e in set(c["code"].tolist()) for left in range(-1, 3)}

    found = L.subset_knots(pairs, ["code", "fold"], subsets)
    knots = spark.createDataFrame([(ENDPOINTS[k // 4], k % 4 - 1, *map(float, v)) for k, v in found.items()], "endpoint string, left_out int, " + ", ".join(f"k{i} double" for i in range(5)))
    sizes = pairs.withColumn("left_out", F.explode(F.filter(F.array(*map(F.lit, range(-1, 3))), lambda x: x != F.col("fold")))).groupBy("endpoint", "left_out").agg((2 * F.count("*")).alias("values"))
    return rounded(knots.join(sizes, ["endpoint", "left_out"]).select("endpoint", "left_out", "values", *[f"k{i}" for i in range(5)]))


@query("feature_moments", """WITH e AS (SELECT CAST(UNNEST(RANGE(64)) AS INTEGER) AS position, UNNEST(embedding) AS v FROM embeddings)
SELECT position, COUNT(*) AS rows, ROUND(AVG(CAST(v AS DOUBLE)), 8) AS mean, ROUND(CASE WHEN STDDEV_POP(v) = 0 THEN 1 ELSE STDDEV_POP(CAST(v AS DOUBLE)) END, 8) AS scale FROM e GROUP BY position""")
def feature_moments(spark, folder):
    pairs = embedding_pairs(spark, folder).withColumns({"outer_fold": F.lit(0), "inner": F.array(F.lit(0))})
    rows, mean, scale = H.feature_moments(pairs, [H.TrainingSet()])[0]
    return rounded(spark.createDataFrame([(i, int(rows), float(m), float(s)) for i, (m, s) in enumerate(zip(mean, scale))], "position int, rows bigint, mean double, scale double"))


@query("logistic_head")
def logistic_head(spark, folder):
    """Heads of both endpoints at every strength on all units: coefficients on the original features."""
    pairs = cut(embedding_pairs(spark, folder).withColumns({"outer_fold": F.lit(0), "inner": F.array(F.lit(0))}))
    heads = H.fit_heads(pairs, [H.TrainingSet()], len(PLAN.endpoints))
    lines = []
    for (e, _, c), head in heads.items():
        w, b = head.raw()
        lines += [(PLAN.endpoints[e], c, i - 1, float(v)) for i, v in enumerate([b, *w])]
    return rounded(spark.createDataFrame(lines, "endpoint string, strength double, position int, coefficient double"), 5)


def calibration_input(spark, folder):
    return predictions(spark, folder).select("endpoint", UNIT, "side", F.col("z").alias("raw"), F.col("label").alias("y"))


@query("calibrators")
def calibrators(spark, folder):
    return rounded(Q.fit_calibrators(cut(calibration_input(spark, folder)), ["endpoint"]), 6)


@query("crossfit_calibration")
def crossfit_calibration(spark, folder):
    rows = calibration_input(spark, folder).withColumn("fold", (S.digest_int(S.keyed_digest(7, F.col(UNIT)), 1) % 3).cast("int"))
    lines, _ = Q.crossfit_calibrate(cut(rows), ["endpoint"], "fold", 3)
    return rounded(lines.groupBy("endpoint", "method").agg(F.count("*").alias("rows"), F.avg(S.binary_nll(F.col("y").cast("double"), F.col("prob"))).alias("nll")), 6)


@query("calibration_slope")
def calibration_slope(spark, folder):
    return rounded(Q.calibration_slope(cut(predictions(spark, folder).select("endpoint", "prob", "label"))), 6)


def model_pairs(spark, folder):
    pair = pair_predictions(spark, folder)
    return pair.withColumn("device_pair", S.device_pair(F.col("device_r"), F.col("device_l"), FIRST_DEVICE, SECOND_DEVICE))


@query("asymmetry_regression")
def asymmetry_regression(spark, folder):
    return rounded(G.asymmetry_model(cut(model_pairs(spark, folder)), f"{SECOND_DEVICE}/{SECOND_DEVICE}"), 6)


def contrast_units(spark, folder):
    return cut(G.contrast_units(predictions(spark, folder), SECOND_DEVICE))


@query("clustered_contrast_model")
def clustered_contrast_model(spark, folder):
    return rounded(G.gee_exchangeable(contrast_units(spark, folder))[0], 7)


@query("state_omnibus_test")
def state_omnibus_test(spark, folder):
    return rounded(G.gee_exchangeable(contrast_units(spark, folder))[1], 6)


@query("mechanism_family")
def mechanism_family(spark, folder):
    adjusted = R.holm(G.holm_family(*G.gee_exchangeable(contrast_units(spark, folder))))
    return rounded(adjusted.withColumn("supported", F.col("adjusted_p") < N(0.05)), 8)


TERM_SQL = {"const": "1", "state_11": "CAST(state = '11' AS INTEGER)", "state_10": "CAST(state = '10' AS INTEGER)", "state_01": "CAST(state = '01' AS INTEGER)", "q1_abnormal": "CAST(q1 = 2 AS INTEGER)",
            "q2_abnormal": "CAST(q2 = 2 AS INTEGER)", "q2_unevaluable": "CAST(q2 NOT IN (1, 2) AS INTEGER)", "side_right": "CAST(side = 1 AS INTEGER)", "device_second": "CAST(device = 'B' AS INTEGER)",
            "mixed_pair": "CAST(device <> partner_device AS INTEGER)"}


@query("estimable_terms", ROWS_SQL + ", r AS (SELECT *, CASE WHEN side = 1 THEN label || '' || partner_label ELSE partner_label || '' || label END AS state FROM pred) " + " UNION ALL ".join(
    f"SELECT endpoint, '{t}' AS term, MAX({x}) = 0 AS constant_zero, MAX({x}) > 0 AS estimable FROM r GROUP BY endpoint" for t, x in TERM_SQL.items()))
def estimable_terms(spark, folder):
    return G.estimable_terms(G.contrast_units(predictions(spark, folder), SECOND_DEVICE))


DESIGN_SQL = PAIRS_SQL + "SELECT endpoint, COUNT(*) AS units, "


@query("evaluable_quality_sums", DESIGN_SQL + """ROUND(SUM((CAST(q1_r = 2 AS DOUBLE) + CAST(q1_l = 2 AS DOUBLE)) / 2), 6) AS q1_mean_sum, ROUND(SUM(CAST(q1_r = 2 AS DOUBLE) - CAST(q1_l = 2 AS DOUBLE)), 6) AS q1_diff_sum
FROM pair WHERE q2_r IN (1, 2) AND q2_l IN (1, 2) GROUP BY endpoint""")
def evaluable_quality_sums(spark, folder):
    """Column totals of the bilateral quality terms over complete pairs."""
    bad = lambda s: S.flag(F.col(f"q1_{s}") == S.ABNORMAL)
    ok = pair_predictions(spark, folder).filter(F.col("q2_r").isin(1, 2) & F.col("q2_l").isin(1, 2))
    return rounded(ok.groupBy("endpoint").agg(F.count("*").alias("units"), F.sum((bad("r") + bad("l")) / N(2)).alias("q1_mean_sum"), F.sum(bad("r") - bad("l")).alias("q1_diff_sum")), 6)


# -- report tables that need a fit ---------------------------------------------------------------------------------------

SEED, REPLICATES = 20261001, 500


@query("base_report")
def base_report(spark, folder):
    """Base-model metrics with calibration intercept and slope, calibration error and loss intervals."""
    rows = cut(predictions(spark, folder).select("endpoint", UNIT, "side", "label", "prob", "nll", "brier"))
    ece = R.calibration_error(R.reliability_bins(rows, R.equal_frequency_edges(rows))).select("endpoint", "ece")
    slope = Q.calibration_slope(rows.select("endpoint", "prob", "label")).withColumnsRenamed({"intercept": "calibration_intercept", "slope": "calibration_slope"}).drop("converged")
    table_ = K.mean_of_units(rows, {"nll": F.col("nll"), "brier": F.col("brier")}).join(R.binary_ranking(rows, F.col("label"), "prob"), "endpoint").join(slope, "endpoint").join(ece, "endpoint")
    for loss in ("nll", "brier"):
        interval = B.bca_interval(K.unit_means(rows, {loss: F.col(loss)}), loss, REPLICATES, [SEED])
        table_ = table_.join(interval.select("endpoint", F.col("lower").alias(f"{loss}_lower"), F.col("upper").alias(f"{loss}_upper")), "endpoint")
    return rounded(table_, 6)


@query("primary_report")
def primary_report(spark, folder):
    """Risk contrast with two-sided interval, one-sided bound and the status in the fixed sequence."""
    units = cut(K.unit_risks(predictions(spark, folder)))
    both = B.bca_interval(units, "contribution", REPLICATES, [SEED]).select("endpoint", "lower", "upper", "method")
    one = B.one_sided_lower(units, "contribution", REPLICATES, SEED).select("endpoint", F.col("lower").alias("one_sided_lower"), "significance_eligible")
    place = F.array_position(F.array(*map(F.lit, ENDPOINTS)), F.col("endpoint")).cast("int") - 1
    gate = R.fixed_sequence(one.withColumns({"position": place, "supported": F.coalesce((F.col("one_sided_lower") > 0) & F.col("significance_eligible"), F.lit(False))}))
    return rounded(K.contrast_of_units(units, ["endpoint"]).join(both, "endpoint").join(gate.drop("significance_eligible"), "endpoint"), 6)
