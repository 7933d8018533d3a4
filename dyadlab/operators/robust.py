"""OLS with HC3 errors and a clustered linear model with exchangeable correlation, from two passes of sums each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.lossmodel import BASIS, KNOTS, spline_basis
from dyadlab.operators.ordering import exact_quantiles
from dyadlab.operators.pairs import UNIT, pair_wide
from dyadlab.operators.risk import asymmetry, square
from dyadlab.operators.sums import Columns, grouped_sums

N = S.number
OTHER_STATES = ("11", "10", "01")
QUALITY_TERMS = ("q1_mean", "q1_diff", "q2_mean", "q2_diff", "second_pair", "mixed_pair")
OLS_TERMS = (
    "const", *[f"evidence_spline_{i}" for i in range(BASIS)], *[f"state_{s}" for s in OTHER_STATES], *QUALITY_TERMS,
    *[f"state_{s}_x_{x}" for s in OTHER_STATES for x in ("q1_diff", "q2_diff", "second")],
)
GEE_TERMS = ("const", *[f"state_{s}" for s in OTHER_STATES], "q1_abnormal", "q2_abnormal", "q2_unevaluable", "side_right", "device_second", "mixed_pair")


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square by the two-step recurrence on degrees of freedom."""
    if x <= 0:
        return 1.0
    tail, start = (math.erfc(math.sqrt(x / 2)), 1) if df % 2 else (math.exp(-x / 2), 2)
    for k in range(start, df, 2):
        tail += (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return tail


def _lines(endpoint: str, terms: Sequence[str], beta: np.ndarray, cov: np.ndarray, *counts: int) -> list[tuple]:
    normal, out = NormalDist(), []
    for name, b, v in zip(terms, beta, np.diag(cov)):
        se = math.sqrt(max(v, 0.0))
        half = normal.inv_cdf(0.975) * se
        p = 2 * (1 - normal.cdf(abs(b / se))) if se > 0 else None
        out.append((endpoint, name, float(b), se, float(b) - half, float(b) + half, p, *counts))
    return out


def asymmetry_model(pairs: DataFrame, second_pair: str) -> DataFrame:
    """Signed asymmetry on an evidence spline, states, bilateral quality, device pair and their interactions, over
    pairs whose second quality code is evaluable on both sides; heteroscedasticity-robust (HC3) errors."""
    spark = pairs.sparkSession
    complete = asymmetry(pairs).filter(F.col("q2_r").isin(1, 2) & F.col("q2_l").isin(1, 2))
    bad = lambda q, s: S.flag(F.col(f"{q}_{s}") == S.ABNORMAL)
    quality = [c for q in ("q1", "q2") for c in ((bad(q, "r") + bad(q, "l")) / N(2), bad(q, "r") - bad(q, "l"))]
    device = [S.flag(F.col("device_pair") == second_pair), S.flag(F.col("device_pair") == "mixed")]
    frame = complete.select(
        "endpoint", "asymmetry", "evidence", F.array(*[S.flag(F.col("state") == s) for s in OTHER_STATES]).alias("states"), F.array(*quality, *device).alias("quality"))
    names = {f"k{i}": i / (KNOTS - 1) for i in range(KNOTS)}
    found = exact_quantiles(frame, "evidence", names, ["endpoint"]).collect()  # one line per endpoint
    endpoints = sorted(r["endpoint"] for r in found)
    knots = {endpoints.index(r["endpoint"]): np.array([r[n] for n in names]) for r in found}
    coded = frame.withColumn("code", F.array_position(F.array(*map(F.lit, endpoints)), F.col("endpoint")).cast("int") - 1).drop("endpoint")

    def design(c: Columns, k: int) -> tuple[np.ndarray, np.ndarray]:
        who = c["code"] == k
        s, q = c["states"][who], c["quality"][who]
        cross = [s[:, i] * q[:, j] for i in range(3) for j in (1, 3, 4)]
        x = np.column_stack([np.ones(who.sum()), spline_basis(c["evidence"][who], knots[k]), s, q, *cross])
        return x, c["asymmetry"][who]

    def first(c: Columns) -> dict[int, np.ndarray]:
        out = {}
        for k in knots:
            x, y = design(c, k)
            if len(y):
                out[k] = np.concatenate([[len(y)], (x.T @ x).ravel(), x.T @ y])
        return out

    p, fits = len(OLS_TERMS), {}
    for k, v in grouped_sums(coded, first).items():
        inverse = np.linalg.pinv(v[1:1 + p * p].reshape(p, p), rcond=1e-12, hermitian=True)
        fits[k] = (int(v[0]), inverse, inverse @ v[1 + p * p:])

    def second(c: Columns) -> dict[int, np.ndarray]:
        out = {}
        for k, (_, inverse, beta) in fits.items():
            x, y = design(c, k)
            if len(y):
                leverage = np.einsum("ij,jk,ik->i", x, inverse, x)
                weight = ((y - x @ beta) / (1 - np.minimum(leverage, 1 - 1e-12))) ** 2
                out[k] = ((x * weight[:, None]).T @ x).ravel()
        return out

    lines = []
    for k, meat in grouped_sums(coded, second).items():
        n, inverse, beta = fits[k]
        lines += _lines(endpoints[k], OLS_TERMS, beta, inverse @ meat.reshape(p, p) @ inverse, n)
    return spark.createDataFrame(lines, "endpoint string, term string, estimate double, standard_error double, lower double, upper double, p_value double, units int")


def contrast_units(rows: DataFrame, second_device: str) -> DataFrame:
    """One line per unit and endpoint: design array and outcome (row-level loss contrast) of each side."""
    y = F.col("nll")
    state = F.when(F.col("side") == 1, S.pair_state(F.col("label"), F.col("partner_label"))).otherwise(S.pair_state(F.col("partner_label"), F.col("label")))
    mixed = S.flag(F.col("device") != F.col("partner_device"))
    x = [N(1), *[S.flag(state == s) for s in OTHER_STATES], *S.indicator_columns(F.col("q1"), F.col("q2"), F.col("side"), F.col("device"), second_device).values(), mixed]
    d = square(y - F.col("predicted_nll_r0")) - square(y - F.col("predicted_nll_r1"))
    flat = {f"x{i}": c for i, c in enumerate([*x, d])}  # scalars, so that pairing stays a hash aggregation
    wide = pair_wide(rows.select("endpoint", UNIT, "side", *[c.alias(n) for n, c in flat.items()]), list(flat), ["endpoint"])
    return wide.select("endpoint", UNIT, *[F.array(*[f"{n}_{s}" for n in flat]).alias(f"x_{s}") for s in "rl"])


def gee_exchangeable(units: DataFrame, iterations: int = 60) -> tuple[DataFrame, DataFrame]:
    """Gaussian, identity link, exchangeable correlation inside a unit, sandwich errors; and the joint Wald test of
    the state terms. Every iteration works on two matrices per endpoint: sums of row products and of unit-total
    products; the data are read once to get them and once for the sandwich."""
    spark = units.sparkSession
    endpoints = sorted(r[0] for r in units.select("endpoint").distinct().collect())
    coded = units.withColumn("code", F.array_position(F.array(*map(F.lit, endpoints)), F.col("endpoint")).cast("int") - 1).select("code", "x_r", "x_l")
    p = len(GEE_TERMS)
    w = p + 1

    def sides(c: Columns, k: int) -> tuple[np.ndarray, np.ndarray]:
        who = c["code"] == k
        return c["x_r"][who], c["x_l"][who]

    def first(c: Columns) -> dict[int, np.ndarray]:
        out = {}
        for k in range(len(endpoints)):
            r, l = sides(c, k)
            if len(r):
                t = r + l
                out[k] = np.concatenate([[len(r)], (r.T @ r + l.T @ l).ravel(), (t.T @ t).ravel()])
        return out

    fits = {}
    for k, v in grouped_sums(coded, first).items():
        n = int(v[0])
        rows, totals = v[1:1 + w * w].reshape(w, w), v[1 + w * w:].reshape(w, w)
        alpha, beta = 0.0, None
        for _ in range(iterations):
            weighted = (rows - alpha * (totals - rows)) / (1 - alpha * alpha)
            bread = np.linalg.pinv(weighted[:p, :p], rcond=1e-12, hermitian=True)
            new = bread @ weighted[:p, p]
            contrast = np.append(-new, 1.0)  # residual = y - x beta
            ssr, total = contrast @ rows @ contrast, contrast @ totals @ contrast
            previous, alpha = alpha, ((total - ssr) / 2) / (ssr / (2 * n - p)) / (n - p)
            done = beta is not None and np.max(np.abs(new - beta)) < 1e-12 and abs(alpha - previous) < 1e-12
            beta = new
            if done:
                break
        weighted = (rows - alpha * (totals - rows)) / (1 - alpha * alpha)
        fits[k] = (n, alpha, beta, np.linalg.pinv(weighted[:p, :p], rcond=1e-12, hermitian=True))

    def second(c: Columns) -> dict[int, np.ndarray]:
        out = {}
        for k, (_, alpha, beta, _) in fits.items():
            r, l = sides(c, k)
            if len(r):
                er, el = r[:, p] - r[:, :p] @ beta, l[:, p] - l[:, :p] @ beta
                u = (r[:, :p] * (er - alpha * el)[:, None] + l[:, :p] * (el - alpha * er)[:, None]) / (1 - alpha * alpha)
                out[k] = (u.T @ u).ravel()
        return out

    lines, tests = [], []
    for k, meat in grouped_sums(coded, second).items():
        n, alpha, beta, bread = fits[k]
        cov = bread @ meat.reshape(p, p) @ bread
        lines += _lines(endpoints[k], GEE_TERMS, beta, cov, n, 2 * n)
        at = slice(1, 1 + len(OTHER_STATES))
        wald = float(beta[at] @ np.linalg.pinv(cov[at, at]) @ beta[at])
        tests.append((endpoints[k], wald, len(OTHER_STATES), chi2_tail(wald, len(OTHER_STATES)), float(alpha)))
    table = spark.createDataFrame(lines, "endpoint string, term string, estimate double, robust_standard_error double, lower double, upper double, p_value double, units int, rows int")
    omnibus = spark.createDataFrame(tests, "endpoint string, statistic double, df int, p_value double, correlation double")
    return table, omnibus


def estimable_terms(units: DataFrame) -> DataFrame:
    """Design columns that are zero everywhere cannot be estimated, whatever number a fit reports for them."""
    largest = [F.max(F.greatest(F.abs(F.get("x_r", i)), F.abs(F.get("x_l", i)))).alias(f"_{i}") for i in range(len(GEE_TERMS))]
    wide = units.groupBy("endpoint").agg(*largest)
    return wide.select("endpoint", F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), (F.col(f"_{i}") == 0).alias("constant_zero"), (F.col(f"_{i}") > 0).alias("estimable")) for i, t in enumerate(GEE_TERMS)])).alias("_t")).select("endpoint", "_t.*")


def holm_family(table: DataFrame, omnibus: DataFrame) -> DataFrame:
    """The three mechanism hypotheses per endpoint as a family: state omnibus and the two quality terms."""
    quality = table.filter(F.col("term").isin("q1_abnormal", "q2_abnormal")).select(F.col("endpoint").alias("family"), F.col("term").alias("hypothesis"), "p_value")
    return omnibus.select(F.col("endpoint").alias("family"), F.lit("state_heterogeneity").alias("hypothesis"), "p_value").unionByName(quality)
