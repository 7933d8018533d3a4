"""Paired-unit views of the order tables, in Spark and in SQL.

A unit is an order with exactly one line 1 and one line 2. Three endpoints put a label and a score on each line;
loss predictions are fixed functions of the own score (baseline) and of both scores (augmented).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.pairs import UNIT, pair_sides, pair_wide
from dyadlab.plans.registry import table

ENDPOINTS = ("discount", "quantity", "price")  # fixed sequence
FIRST_DEVICE, SECOND_DEVICE = "A", "B"
N = S.number


def nine_digits(c: Column) -> Column:
    """Drop bits beyond nine decimals, so that engines whose exp/log differ in the last bit agree on ties."""
    return F.floor(c * N(1e9) + N(0.5)) / N(1e9)


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines 1 and 2 with numeric codes (numbers keep the pivot a hash aggregation)."""
    return table(spark, folder, "lineitem").filter(F.col("l_linenumber").isin(1, 2)).select(
        F.col("l_orderkey").alias("unit_id"),
        F.col("l_linenumber").alias("side"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("dev"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("q1"),
        F.when(F.col("l_tax") >= N(0.075), 0).when(F.col("l_tax") >= N(0.055), 2).otherwise(1).alias("q2"),
        F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )


def _endpoint(name: str, label: Column, z: Column) -> Column:
    return F.struct(F.lit(name).alias("endpoint"), label.cast("int").alias("label"), z.alias("z"))


def endpoint_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per unit, side and endpoint, both sides' scores on each. One shuffle, on the unit."""
    values = ["dev", "q1", "q2", "discount", "quantity", "price"]
    pairs = pair_wide(raw_lines(spark, folder), values)

    def scores(s: str) -> Column:
        d, q, p = F.col(f"discount_{s}"), F.col(f"quantity_{s}"), F.col(f"price_{s}")
        return F.array(
            _endpoint("discount", d >= N(0.075), N(40) * (d - N(0.07)) + (q - N(25)) / N(12)),
            _endpoint("quantity", q >= N(38), (q - N(38)) / N(6) + N(30) * (d - N(0.05))),
            _endpoint("price", p >= N(60000), (p - N(60000)) / N(15000) + (q - N(25)) / N(20)),
        )

    both = pairs.select(UNIT, "dev_r", "dev_l", "q1_r", "q1_l", "q2_r", "q2_l", F.explode(F.arrays_zip(scores("r").alias("r"), scores("l").alias("l"))).alias("e"))
    wide = both.select(
        UNIT, F.col("e.r.endpoint").alias("endpoint"),
        *[F.col(f"{c}_{s}") for c in ("dev", "q1", "q2") for s in "rl"],
        *[F.col(f"e.{s}.{c}").alias(f"{c}_{s}") for c in ("label", "z") for s in "rl"],
    )
    rows = pair_sides(wide, ["dev", "q1", "q2", "label", "z"], [UNIT, "endpoint"])
    names = {c: F.when(F.col(d) == 1, FIRST_DEVICE).otherwise(SECOND_DEVICE) for c, d in (("device", "dev"), ("partner_device", "partner_dev"))}
    return rows.withColumns({**names, "prob": nine_digits(N(1) / (N(1) + F.exp(-F.col("z"))))}).drop("dev", "partner_dev")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The long prediction table: losses and loss predictions per unit, side and endpoint."""
    y, p, z, gap = F.col("label").cast("double"), F.col("prob"), F.col("z"), F.abs(F.col("z") - F.col("partner_z"))
    base_nll = F.log1p(F.exp(-F.abs(z)))
    base_brier = p * (N(1) - p)
    return endpoint_rows(spark, folder).withColumns({
        "nll": nine_digits(S.binary_nll(y, p)),
        "brier": nine_digits(S.brier(y, p)),
        "predicted_class": S.predicted_class(p),
        "predicted_nll_r0": nine_digits(base_nll),
        "predicted_nll_r1": nine_digits(base_nll + N(0.05) * gap),
        "predicted_brier_r0": nine_digits(base_brier),
        "predicted_brier_r1": nine_digits(base_brier + N(0.02) * gap / (N(1) + gap)),
    })


def pair_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One line per unit and endpoint (the unit's partitioning is reused; no second shuffle)."""
    return pair_wide(predictions(spark, folder).withColumn("dev", F.when(F.col("device") == FIRST_DEVICE, 1).otherwise(2)),
                     ["label", "z", "prob", "nll", "q1", "q2", "dev"], ["endpoint"]).withColumns({
        **{f"device_{s}": F.when(F.col(f"dev_{s}") == 1, FIRST_DEVICE).otherwise(SECOND_DEVICE) for s in "rl"},
        "state": S.pair_state(F.col("label_r"), F.col("label_l")),
    }).drop("dev_r", "dev_l")


# The same views in SQL: chain of common table expressions, to be followed by a SELECT.
ROWS_SQL = """
WITH two AS (
  SELECT l_orderkey AS unit_id, l_linenumber AS side,
    CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS device,
    CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS q1,
    CASE WHEN l_tax >= 0.075 THEN 0 WHEN l_tax >= 0.055 THEN 2 ELSE 1 END AS q2,
    l_discount AS d, l_quantity AS q, l_extendedprice AS p
  FROM lineitem WHERE l_linenumber IN (1, 2)),
clean AS (
  SELECT unit_id FROM two GROUP BY unit_id HAVING COUNT(*) = 2 AND COUNT(DISTINCT side) = 2),
base AS (SELECT two.* FROM two JOIN clean ON two.unit_id = clean.unit_id),
ends AS (
  SELECT unit_id, side, device, q1, q2, 'discount' AS endpoint, CASE WHEN d >= 0.075 THEN 1 ELSE 0 END AS label,
    CAST(40 * (d - 0.07) + (q - 25) / 12.0 AS DOUBLE) AS z FROM base
  UNION ALL
  SELECT unit_id, side, device, q1, q2, 'quantity', CASE WHEN q >= 38 THEN 1 ELSE 0 END,
    CAST((q - 38) / 6.0 + 30 * (d - 0.05) AS DOUBLE) FROM base
  UNION ALL
  SELECT unit_id, side, device, q1, q2, 'price', CASE WHEN p >= 60000 THEN 1 ELSE 0 END,
    CAST((p - 60000) / 15000.0 + (q - 25) / 20.0 AS DOUBLE) FROM base),
scored AS (SELECT *, FLOOR((1.0 / (1.0 + EXP(-z))) * 1e9 + 0.5) / 1e9 AS prob FROM ends),
clipped AS (SELECT *, GREATEST(1e-6, LEAST(1.0 - 1e-6, prob)) AS pc FROM scored),
pred AS (
  SELECT o.unit_id, o.side, o.device, o.q1, o.q2, o.endpoint, o.label, o.z, o.prob, f.z AS partner_z, f.q1 AS partner_q1,
    f.q2 AS partner_q2, f.label AS partner_label, f.device AS partner_device,
    FLOOR((-(o.label * LN(o.pc) + (1 - o.label) * LN(1.0 - o.pc))) * 1e9 + 0.5) / 1e9 AS nll,
    FLOOR(((o.prob - o.label) * (o.prob - o.label)) * 1e9 + 0.5) / 1e9 AS brier,
    CASE WHEN o.prob >= 0.5 THEN 1 ELSE 0 END AS predicted_class,
    FLOOR((LN(1.0 + EXP(-ABS(o.z)))) * 1e9 + 0.5) / 1e9 AS predicted_nll_r0,
    FLOOR((LN(1.0 + EXP(-ABS(o.z))) + 0.05 * ABS(o.z - f.z)) * 1e9 + 0.5) / 1e9 AS predicted_nll_r1,
    FLOOR((o.prob * (1.0 - o.prob)) * 1e9 + 0.5) / 1e9 AS predicted_brier_r0,
    FLOOR((o.prob * (1.0 - o.prob) + 0.02 * ABS(o.z - f.z) / (1.0 + ABS(o.z - f.z))) * 1e9 + 0.5) / 1e9 AS predicted_brier_r1
  FROM clipped o JOIN clipped f ON o.unit_id = f.unit_id AND o.endpoint = f.endpoint AND o.side = 3 - f.side)
"""
PAIRS_SQL = ROWS_SQL + """,
pair AS (
  SELECT unit_id, endpoint, CAST(label AS VARCHAR) || CAST(partner_label AS VARCHAR) AS state,
    label AS label_r, partner_label AS label_l, z AS z_r, partner_z AS z_l, q1 AS q1_r, partner_q1 AS q1_l,
    q2 AS q2_r, partner_q2 AS q2_l, device AS device_r, partner_device AS device_l
  FROM pred WHERE side = 1)
"""
UNITS_SQL = PAIRS_SQL + """,
unit_risk AS (
  SELECT endpoint, unit_id, AVG(nll) AS observed_loss, AVG((nll - predicted_nll_r0) * (nll - predicted_nll_r0)) AS risk_r0,
    AVG((nll - predicted_nll_r1) * (nll - predicted_nll_r1)) AS risk_r1
  FROM pred GROUP BY endpoint, unit_id),
contrib AS (SELECT *, risk_r0 - risk_r1 AS contribution FROM unit_risk)
"""
