"""Temperature and Platt calibrators for many score columns at once, and calibration slopes.

The data side is a plain grouped aggregation (sums of losses and their derivatives per key); the driver only moves
one or two parameters per key between passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.lockstep import minimise

N = S.number
METHODS = ("temperature", "platt")
SLOPE_BOUNDS, INTERCEPT_BOUNDS = (0.05, 20.0), (-10.0, 10.0)  # fixed values


def calibrated(raw: Column, slope: Column, intercept: Column) -> Column:
    return S.sigmoid(slope * raw + intercept)


def _fit(rows: DataFrame, keys: Sequence[str], methods: Sequence[str], eps: float, bounded: bool) -> dict[tuple, tuple]:
    """``rows`` holds keys, raw and y. Returns (key..., method) -> (slope, intercept, converged)."""
    spark = rows.sparkSession
    known = [tuple(r) for r in rows.select(*keys).distinct().collect()]
    names = [(*k, m) for k in known for m in methods]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", fit int, slope double, intercept double"
    a, b, x, y = F.col("slope"), F.col("intercept"), F.col("raw"), F.col("y").cast("double")

    def evaluate(points):
        lines = [(*names[t][:-1], t, float(v[0]), float(v[1])) for t, v in points.items()]
        trial = F.broadcast(spark.createDataFrame(lines, schema))  # one line per open fit
        p = S.sigmoid(a * x + b)
        live = ~S.is_clipped(p, eps)  # a clipped probability does not move with the parameters
        moved = rows.join(trial, list(keys)).select("fit", "raw", S.binary_nll(y, p, eps).alias("loss"),
                                                    F.when(live, p - y).otherwise(N(0)).alias("r"), F.when(live, p * (N(1) - p)).otherwise(N(0)).alias("h"))
        r, h = F.col("r"), F.col("h")
        sums = moved.groupBy("fit").agg(
            F.count("*").alias("n"), F.sum("loss"), F.sum(r * x), F.sum(r), F.sum(h * x * x), F.sum(h * x), F.sum(h)).collect()
        out = {}
        for row in sums:
            n, loss, ga, gb, haa, hab, hbb = (float(v) for v in row[1:])
            g, m = np.array([ga, gb]) / n, np.array([[haa, hab], [hab, hbb]]) / n
            if names[row[0]][-1] == "temperature":  # the intercept stays at zero
                g[1], m = 0.0, np.array([[m[0, 0], 0.0], [0.0, 1.0]])
            out[row[0]] = (loss / n, g, m)
        return out

    low, high = (np.array([SLOPE_BOUNDS[0], INTERCEPT_BOUNDS[0]]), np.array([SLOPE_BOUNDS[1], INTERCEPT_BOUNDS[1]])) if bounded else (None, None)
    fits = minimise({t: np.array([1.0, 0.0]) for t in range(len(names))}, evaluate, tolerance=1e-9, passes=60, low=low, high=high)
    return {names[t]: (float(f.x[0]), float(f.x[1]), f.converged or f.stalled) for t, f in fits.items()}


def fit_calibrators(rows: DataFrame, keys: Sequence[str], methods: Sequence[str] = METHODS, eps: float = S.PRIMARY_CLIP) -> DataFrame:
    """Parameter table (keys, method, slope, intercept, converged): minimum mean clipped loss inside the bounds."""
    fitted = _fit(rows, keys, methods, eps, bounded=True)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", method string, slope double, intercept double, converged boolean"
    return rows.sparkSession.createDataFrame([(*k, *v) for k, v in fitted.items()], schema)


def crossfit_training(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """Each row once per training set it belongs to: every left-out fold but its own, and -1 for none left out."""
    sets = F.filter(F.sequence(F.lit(-1), F.lit(folds - 1)), lambda k: k != F.col(fold))
    return rows.withColumn("left_out", F.explode(sets))


def crossfit_calibrate(rows: DataFrame, keys: Sequence[str], fold: str, folds: int, methods: Sequence[str] = METHODS) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold calibrated probabilities (one line per row and method) and the parameter table."""
    table = fit_calibrators(crossfit_training(rows, fold, folds), [*keys, "left_out"], methods)
    own = table.withColumnRenamed("left_out", fold)
    joined = rows.join(F.broadcast(own), [*keys, fold])  # keys x folds x methods lines
    return joined.withColumn("prob", calibrated(F.col("raw"), F.col("slope"), F.col("intercept"))), table


def calibration_slope(rows: DataFrame, keys: Sequence[str] = ("endpoint",), eps: float = S.PRIMARY_CLIP) -> DataFrame:
    """Intercept and slope of an unpenalised logistic model of the label on the logit; null where it does not converge."""
    logits = rows.select(*keys, S.logit(F.col("prob"), eps).alias("raw"), F.col("label").alias("y"))
    fitted = _fit(logits, keys, ["platt"], 1e-15, bounded=False)
    types = {f.name: f.dataType.simpleString() for f in logits.schema}
    lines = [(*k[:-1], b if ok else None, a if ok else None, ok) for k, (a, b, ok) in fitted.items()]
    return rows.sparkSession.createDataFrame(lines, ", ".join(f"{k} {types[k]}" for k in keys) + ", intercept double, slope double, converged boolean")
