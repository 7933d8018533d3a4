"""Scalar functions, ordering, selection rules and report tables on the paired order view."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import blocks as X
from dyadlab.operators import ranking as R
from dyadlab.operators import risk as K
from dyadlab.operators.lossmodel import indicator_arrays
from dyadlab.operators.ordering import positions
from dyadlab.operators.pairs import UNIT, attach_unit, pair_wide
from dyadlab.plans.audit_queries import SRC, source
from dyadlab.plans.registry import query, table
from dyadlab.plans.risk_queries import DIRECTION, RANKING_SQL, error_column, rounded
from dyadlab.plans.views import FIRST_DEVICE, PAIRS_SQL, ROWS_SQL, SECOND_DEVICE, UNITS_SQL, pair_predictions, predictions
from dyadlab.session import cut

N = S.number


@query("row_losses", ROWS_SQL + """SELECT unit_id, side, endpoint, ROUND(prob, 10) AS prob, ROUND(pc, 10) AS clipped_prob, ROUND(LN(pc) - LN(1 - pc), 6) AS logit, ROUND(1 / (1 + EXP(-z)), 7) AS sigmoid,
  ROUND(-(label * LN(pc) + (1 - label) * LN(1 - pc)), 7) AS nll, ROUND((prob - label) * (prob - label), 7) AS brier, ROUND(GREATEST(prob, 1 - prob), 10) AS confidence, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS predicted_class,
  prob < 1e-6 OR prob > 1 - 1e-6 AS clipped FROM clipped""")
def row_losses(spark, folder):
    y, p = F.col("label").cast("double"), F.col("prob")
    rows = predictions(spark, folder).select(
        UNIT, "side", "endpoint", "prob", S.clip_probability(p).alias("clipped_prob"), S.logit(p).alias("logit"), S.sigmoid(F.col("z")).alias("sigmoid"), S.binary_nll(y, p).alias("nll"),
        S.brier(y, p).alias("brier"), S.confidence(p).alias("confidence"), S.predicted_class(p).alias("predicted_class"), S.is_clipped(p).alias("clipped"))
    return rounded(rows, 7, prob=10, clipped_prob=10, confidence=10, logit=6)


@query("strict_casts", SRC + """SELECT unit_id, side, CAST(side AS INTEGER) AS side_code, CASE side WHEN 1 THEN 'R' WHEN 2 THEN 'L' END AS laterality, CAST(q1 AS INTEGER) AS q1, CAST(q2 AS INTEGER) AS q2, CAST(y1 AS INTEGER) AS y1,
  TRY_CAST(anatomy AS DOUBLE) AS anatomy, 'development' AS "partition", 'images/' || row_id || '.jpg' AS path FROM src WHERE side IN (1, 2)""")
def strict_casts(spark, folder):
    """Typed stage frame: strict casts (a bad code stops the job), lenient cast of anatomy, mapped side, constants."""
    rows = source(spark, folder).filter(F.col("side").isin(1, 2))
    return rows.select(
        UNIT, "side", F.col("side").cast("int").alias("side_code"), S.code_label(F.col("side"), {1: "R", 2: "L"}).alias("laterality"), *[F.col(c).cast("int").alias(c) for c in ("q1", "q2", "y1")],
        S.lenient_number(F.col("anatomy")).alias("anatomy"), F.lit("development").alias("partition"), F.concat(F.lit("images/"), F.col("row_id"), F.lit(".jpg")).alias("path"))


@query("indicator_rows", ROWS_SQL + """SELECT unit_id, side, endpoint, CAST(q1 = 2 AS DOUBLE) AS q1_abnormal, CAST(q2 = 2 AS DOUBLE) AS q2_abnormal, CAST(q2 NOT IN (1, 2) AS DOUBLE) AS q2_unevaluable,
  CAST(side = 1 AS DOUBLE) AS side_right, CAST(device = 'B' AS DOUBLE) AS device_second FROM pred""")
def indicator_rows(spark, folder):
    flags = S.indicator_columns(F.col("q1"), F.col("q2"), F.col("side"), F.col("device"), SECOND_DEVICE)
    return predictions(spark, folder).select(UNIT, "side", "endpoint", *[c.alias(n) for n, c in flags.items()])


@query("directional_rows", ROWS_SQL + "SELECT unit_id, side, endpoint, " + DIRECTION.format("q1") + " AS q1_stratum, " + DIRECTION.format("q2") + " AS q2_stratum FROM pred")
def directional_rows(spark, folder):
    return predictions(spark, folder).select(UNIT, "side", "endpoint", *[S.directional_stratum(F.col(q), F.col(f"partner_{q}")).alias(f"{q}_stratum") for q in ("q1", "q2")])


@query("canonical_order", SRC + """, k AS (SELECT CASE WHEN unit_id % 10 = 3 THEN 'x' || unit_id ELSE CAST(unit_id AS VARCHAR) END AS key, side, l_partkey, l_suppkey, price FROM src)
SELECT key, side, l_partkey, l_suppkey, price, ROW_NUMBER() OVER (ORDER BY TRY_CAST(key AS BIGINT) NULLS LAST, key, side, l_partkey, l_suppkey, price) AS position FROM k""")
def canonical_order(spark, folder):
    """Row numbers in the canonical order: numeric ids first, then text ids, then side."""
    text = F.col(UNIT).cast("string")
    rows = source(spark, folder).select(F.when(F.col(UNIT) % 10 == 3, F.concat(F.lit("x"), text)).otherwise(text).alias("key"), "side", "l_partkey", "l_suppkey", "price")
    numbered = rows.withColumn("_number", S.whole_number(F.col("key")))
    ordered = positions(numbered, [F.col("_number").asc_nulls_last(), "key", "side", "l_partkey", "l_suppkey", "price"])
    return ordered.select("key", "side", "l_partkey", "l_suppkey", "price", (F.col("pos") + 1).alias("position"))


@query("report_head", UNITS_SQL + "SELECT endpoint, unit_id, ROUND(contribution, 8) AS contribution FROM contrib ORDER BY observed_loss DESC, endpoint, unit_id LIMIT 50")
def report_head(spark, folder):
    """The first 50 lines of a report table (the limit is the feature)."""
    units = K.unit_risks(predictions(spark, folder))
    return rounded(units.orderBy(F.col("observed_loss").desc(), "endpoint", UNIT).limit(50).select("endpoint", UNIT, "contribution"))


@query("formatted_risk", UNITS_SQL + "SELECT endpoint, PRINTF('%.4f', AVG(risk_r0)) AS risk_r0, PRINTF('%.4f', AVG(risk_r1)) AS risk_r1, PRINTF('%.6f', AVG(contribution)) AS delta FROM contrib GROUP BY endpoint")
def formatted_risk(spark, folder):
    risk = K.risk_contrast(predictions(spark, folder))
    return risk.select("endpoint", S.fixed_decimals(F.col("risk_r0"), 4).alias("risk_r0"), S.fixed_decimals(F.col("risk_r1"), 4).alias("risk_r1"), S.fixed_decimals(F.col("delta"), 6).alias("delta"))


@query("pseudonyms", "SELECT c_custkey AS unit_id, SHA256('20260829|' || c_custkey) AS pseudonym, CASE WHEN c_acctbal = 0 THEN NULL ELSE ROUND(1000.0 * c_nationkey / c_acctbal, 8) END AS ratio FROM customer")
def pseudonyms(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias(UNIT), S.keyed_digest(20260829, F.col("c_custkey")).alias("pseudonym"), S.safe_ratio(N(1000) * F.col("c_nationkey"), F.col("c_acctbal")).alias("ratio"))
    return rounded(rows)


@query("attached_unit_attributes", PAIRS_SQL + """SELECT p.unit_id, p.side, p.endpoint, pair.state, CASE WHEN device_r = device_l THEN device_r || '/' || device_l ELSE 'mixed' END AS device_pair FROM pred p JOIN pair ON p.unit_id = pair.unit_id AND p.endpoint = pair.endpoint""")
def attached_unit_attributes(spark, folder):
    """Unit attributes joined back onto rows; a row without its unit is an error."""
    units = pair_predictions(spark, folder).select(UNIT, "endpoint", "state", S.device_pair(F.col("device_r"), F.col("device_l"), FIRST_DEVICE, SECOND_DEVICE).alias("device_pair"))
    return attach_unit(predictions(spark, folder).select(UNIT, "side", "endpoint"), units, [UNIT, "endpoint"], "state")


@query("order_attributes", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, c_mktsegment, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def order_attributes(spark, folder):
    """Many-to-one attributes along a chain of keys; small dimension tables are broadcast by their size on disk."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders, customers = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus", "c_mktsegment", "n_name", "r_name")


# -- selection rules on grouped data -----------------------------------------------------------------------------------


@query("modal_choice", "WITH c AS (SELECT c_nationkey, c_mktsegment, COUNT(*) AS times FROM customer GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY times DESC, c_mktsegment) AS k FROM c) SELECT c_nationkey, c_mktsegment, times FROM r WHERE k = 1")
def modal_choice(spark, folder):
    return R.modal_choice(table(spark, folder, "customer"), "c_mktsegment", F.col("c_mktsegment"), ["c_nationkey"])


@query("best_within_tolerance", ROWS_SQL + """, c AS (SELECT endpoint, clip, AVG(-(label * LN(GREATEST(clip, LEAST(1 - clip, prob))) + (1 - label) * LN(1 - GREATEST(clip, LEAST(1 - clip, prob))))) AS risk
  FROM pred, (SELECT UNNEST([0.3::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE, 0.05::DOUBLE, 0.001::DOUBLE, 0.000001::DOUBLE]) AS clip) v GROUP BY endpoint, clip),
m AS (SELECT *, MIN(risk) OVER (PARTITION BY endpoint) AS low FROM c), e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY endpoint ORDER BY clip DESC) AS k FROM m WHERE risk <= low + 1e-3) SELECT endpoint, clip, ROUND(risk, 8) AS risk FROM e WHERE k = 1""")
def best_within_tolerance(spark, folder):
    """Lowest mean loss over candidate clips; among near ties the largest clip."""
    y, p = F.col("label").cast("double"), F.col("prob")
    long = predictions(spark, folder).select("endpoint", F.explode(F.array(*[F.struct(N(c).alias("clip"), S.binary_nll(y, p, c).alias("nll")) for c in (0.3, 0.2, 0.1, 0.05, 0.001, 0.000001)])).alias("_c")).select("endpoint", "_c.*")
    candidates = long.groupBy("endpoint", "clip").agg(F.avg("nll").alias("risk"))
    return rounded(R.best_within_tolerance(candidates, "risk", [F.col("clip").desc()], ["endpoint"], 1e-3))


# -- set rules -----------------------------------------------------------------------------------------------------------


@query("set_rules", """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N'), o AS (SELECT o_orderkey AS k FROM orders),
l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT 'intersection_empty' AS rule, COUNT(*) AS violations, COUNT(*) = 0 AS passed FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'lines_within_orders', COUNT(*), COUNT(*) = 0 FROM (SELECT k FROM l EXCEPT SELECT k FROM o)
UNION ALL SELECT 'orders_within_lines', COUNT(*), COUNT(*) = 0 FROM (SELECT k FROM o EXCEPT SELECT k FROM l)""")
def set_rules(spark, folder):
    """Empty intersection (leakage) and set equality of ids in both directions."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    ids = lambda df: df.select(F.col("l_orderkey").alias("k"))
    keys = {"intersection_empty": ids(lines.filter("l_returnflag = 'R'")).intersect(ids(lines.filter("l_returnflag = 'N'"))),
            "lines_within_orders": ids(lines).distinct().join(orders, "k", "left_anti"), "orders_within_lines": orders.join(ids(lines), "k", "left_anti")}
    out = None
    for rule, found in keys.items():
        line = found.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations", (F.col("violations") == 0).alias("passed"))
        out = line if out is None else out.unionByName(line)
    return out


# -- report tables -------------------------------------------------------------------------------------------------------


@query("base_metrics", ROWS_SQL + RANKING_SQL.format(keys="endpoint", score="prob", y="label", rows="pred") + """SELECT p.endpoint, COUNT(DISTINCT unit_id) AS units, COUNT(*) AS rows, COUNT(*) FILTER (WHERE label = 1) AS positives, ROUND(AVG(CAST(label AS DOUBLE)), 7) AS prevalence,
  ROUND(AVG(nll), 7) AS nll, ROUND(AVG(brier), 7) AS brier, ROUND(AVG(CAST(predicted_class AS DOUBLE)) FILTER (WHERE label = 1), 7) AS sensitivity, ROUND(AVG(CAST(1 - predicted_class AS DOUBLE)) FILTER (WHERE label = 0), 7) AS specificity,
  COUNT(*) FILTER (WHERE prob < 1e-6 OR prob > 1 - 1e-6) AS clipped, ROUND(MAX(area / a.positives / negatives), 7) AS auroc, ROUND(MAX(steps / a.positives), 7) AS average_precision FROM pred p JOIN a ON p.endpoint = a.endpoint GROUP BY p.endpoint""")
def base_metrics(spark, folder):
    """Base-model metrics, one line per endpoint."""
    rows = predictions(spark, folder)
    y, c = F.col("label"), F.col("predicted_class").cast("double")
    basic = rows.groupBy("endpoint").agg(
        F.count_if(F.col("side") == 1).alias("units"), F.count("*").alias("rows"), F.count_if(y == 1).alias("positives"), F.avg(y.cast("double")).alias("prevalence"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"),
        F.avg(F.when(y == 1, c)).alias("sensitivity"), F.avg(F.when(y == 0, N(1) - c)).alias("specificity"), F.count_if(S.is_clipped(F.col("prob"))).alias("clipped"))
    return rounded(basic.join(R.binary_ranking(rows, y, "prob").drop("positives", "negatives"), "endpoint"), 7)


@query("secondary_metrics", ROWS_SQL + RANKING_SQL.format(keys="endpoint", score="predicted_nll_r1", y="(CASE WHEN predicted_class <> label THEN 1 ELSE 0 END)", rows="pred") + """, u AS (SELECT endpoint, unit_id, AVG(ABS(nll - predicted_nll_r0) - ABS(nll - predicted_nll_r1)) AS g FROM pred GROUP BY endpoint, unit_id),
m AS (SELECT endpoint, AVG(g) AS mae FROM u GROUP BY endpoint), cv AS (SELECT endpoint, ROW_NUMBER() OVER o AS k, CAST(SUM(CASE WHEN predicted_class <> label THEN 1 ELSE 0 END) OVER o AS DOUBLE) AS e FROM pred WINDOW o AS (PARTITION BY endpoint ORDER BY predicted_nll_r1, unit_id, side ROWS UNBOUNDED PRECEDING)),
c AS (SELECT endpoint, AVG(e / k) AS aurc, CAST(MAX(e) AS BIGINT) AS errors FROM cv GROUP BY endpoint),
r AS (SELECT endpoint, """ + ", ".join(f"RANK() OVER (PARTITION BY endpoint ORDER BY {col}) + (COUNT(*) OVER (PARTITION BY endpoint, {col}) - 1) / 2.0 AS {n}" for col, n in (("nll", "o"), ("predicted_nll_r0", "p0"), ("predicted_nll_r1", "p1"))) + """ FROM pred),
s AS (SELECT endpoint, CORR(o, p0) AS s0, CORR(o, p1) AS s1 FROM r GROUP BY endpoint)
SELECT a.endpoint, ROUND(mae, 7) AS mae_improvement, ROUND(s0, 7) AS spearman_r0, ROUND(s1, 7) AS spearman_r1, errors, ROUND(aurc, 7) AS aurc, ROUND(area / positives / negatives, 7) AS error_auroc FROM a JOIN m ON a.endpoint = m.endpoint JOIN c ON a.endpoint = c.endpoint JOIN s ON a.endpoint = s.endpoint""")
def secondary_metrics(spark, folder):
    """Secondary metrics, one line per endpoint, from one stored copy of the rows."""
    rows = cut(predictions(spark, folder).select("endpoint", UNIT, "side", "label", "predicted_class", "nll", "predicted_nll_r0", "predicted_nll_r1"))
    curve = R.coverage_summary(R.risk_coverage(rows, error_column(), "predicted_nll_r1")).select("endpoint", "errors", "aurc")
    detect = R.binary_ranking(rows.withColumn("error", error_column()), F.col("error"), "predicted_nll_r1").select("endpoint", F.col("auroc").alias("error_auroc"))
    mae = K.mae_improvement(rows).select("endpoint", "mae_improvement")
    return rounded(mae.join(R.spearman(rows, "nll", ["predicted_nll_r0", "predicted_nll_r1"]), "endpoint").join(curve, "endpoint").join(detect, "endpoint"), 7)


# -- protocol controls ---------------------------------------------------------------------------------------------------


@query("negative_control_risk", UNITS_SQL + """, d AS (SELECT unit_id, endpoint, state, z_r, z_l, SHA256('77|' || unit_id) AS digest FROM pair), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY endpoint, state ORDER BY digest, unit_id) AS i, COUNT(*) OVER (PARTITION BY endpoint, state) AS n FROM d),
c AS (SELECT a.unit_id, a.endpoint, b.z_r, b.z_l FROM k a JOIN k b ON a.endpoint = b.endpoint AND a.state = b.state AND b.i = a.i % a.n + 1),
r AS (SELECT p.endpoint, p.unit_id, AVG((nll - predicted_nll_r0) * (nll - predicted_nll_r0)) AS r0, AVG(POW(nll - predicted_nll_r0 - 0.05 * ABS(p.z - CASE WHEN p.side = 1 THEN c.z_l ELSE c.z_r END), 2)) AS rc FROM pred p JOIN c ON p.unit_id = c.unit_id AND p.endpoint = c.endpoint GROUP BY p.endpoint, p.unit_id)
SELECT endpoint, COUNT(*) AS units, ROUND(AVG(r0), 8) AS risk_r0, ROUND(AVG(rc), 8) AS risk_control, ROUND(AVG(r0 - rc), 8) AS delta_control FROM r GROUP BY endpoint""")
def negative_control_risk(spark, folder):
    """The augmented prediction with an unrelated unit of the same state in the partner's place."""
    from dyadlab.operators.cohort import unrelated_partner

    pairs = cut(pair_wide(predictions(spark, folder), ["z", "nll", "predicted_nll_r0", "label"], ["endpoint"]))
    keyed = pairs.withColumn("stratum", F.concat_ws("|", "endpoint", S.pair_state(F.col("label_r"), F.col("label_l")))).withColumn("payload", F.array("z_r", "z_l"))
    control = unrelated_partner(keyed, "stratum", ["payload", "endpoint"], 77).select(UNIT, F.col("control_endpoint").alias("endpoint"), F.col("control_payload").alias("other"))
    base = {s: K.square(F.col(f"nll_{s}") - F.col(f"predicted_nll_r0_{s}")) for s in "rl"}
    with_other = {s: K.square(F.col(f"nll_{s}") - F.col(f"predicted_nll_r0_{s}") - N(0.05) * F.abs(F.col(f"z_{s}") - F.col("other")[1 if s == "r" else 0])) for s in "rl"}
    half = lambda d: (d["r"] + d["l"]) / N(2)
    risks = pairs.join(control, [UNIT, "endpoint"]).select("endpoint", half(base).alias("r0"), half(with_other).alias("rc"))
    return rounded(risks.groupBy("endpoint").agg(F.count("*").alias("units"), F.avg("r0").alias("risk_r0"), F.avg("rc").alias("risk_control"), F.avg(F.col("r0") - F.col("rc")).alias("delta_control")))


def block_frame(spark, folder):
    """Wide pairs with losses, indicator arrays and a hash fold per unit."""
    wide = pair_wide(predictions(spark, folder).withColumn("dev", F.when(F.col("device") == FIRST_DEVICE, 1).otherwise(2)), ["z", "nll", "brier", "q1", "q2", "dev"], ["endpoint"])
    named = wide.withColumns({f"device_{s}": F.when(F.col(f"dev_{s}") == 1, FIRST_DEVICE).otherwise(SECOND_DEVICE) for s in "rl"})
    return cut(indicator_arrays(named, SECOND_DEVICE).withColumn("fold", (S.digest_int(S.keyed_digest(11, F.col(UNIT)), 1) % 5).cast("int")))


@query("block_contributions")
def block_contributions(spark, folder):
    return rounded(X.block_contributions(block_frame(spark, folder), 5), 7)


@query("without_quality_risk")
def without_quality_risk(spark, folder):
    """Sensitivity of the contrast to leaving the quality columns out of both models."""
    subsets = {"r0": ("own_score", "quality", "acquisition"), "r1": tuple(X.BLOCKS), "r0_core": ("own_score", "acquisition"), "r1_core": X.WITHOUT_QUALITY}
    risks = X.subset_risks(block_frame(spark, folder), subsets, 5)
    wide = risks.groupBy("endpoint", "units").agg(*[F.max(F.when(F.col("blocks") == n, F.col("risk"))).alias(n) for n in subsets])
    return rounded(wide.withColumns({"delta": F.col("r0") - F.col("r1"), "delta_core": F.col("r0_core") - F.col("r1_core")}), 7)
