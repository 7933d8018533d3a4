"""Cross-fitted risk of loss models built from blocks of design columns, all from one matrix per fold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.operators import lossmodel as L
from dyadlab.operators.sums import Columns, grouped_sums

BLOCKS = {
    "own_score": L.OWN,
    "quality": ("q1_abnormal", "q2_abnormal", "q2_unevaluable"),
    "acquisition": ("side_right", "device_second"),
    "partner_score": L.PARTNER,
}
SEQUENCES = {"forward": tuple(BLOCKS), "reverse": tuple(reversed(BLOCKS))}
WITHOUT_QUALITY = ("own_score", "acquisition", "partner_score")


def columns_of(blocks: Sequence[str]) -> tuple[str, ...]:
    return tuple(c for b in blocks for c in BLOCKS[b])


def subset_risks(frame: DataFrame, subsets: dict[str, Sequence[str]], folds: int, target: str = "nll", alpha: float = 1.0) -> DataFrame:
    """Unit-mean squared error of each block subset, every unit predicted by models fitted without its fold.

    ``frame`` holds endpoint, fold, z, flags, nll and brier of both sides in wide form. Two passes, whatever the
    number of subsets.
    """
    spark = frame.sparkSession
    endpoints = sorted(r[0] for r in frame.select("endpoint").distinct().collect())
    narrow = frame.withColumn("set_code", F.array_position(F.array(*map(F.lit, endpoints)), F.col("endpoint")).cast("int") - 1).select(
        "set_code", "fold", "z_r", "z_l", "flags_r", "flags_l", *[f"{t}_{s}" for t in L.TARGETS for s in "rl"])
    spread = narrow.withColumn("left_out", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))))
    knots = {k[0] * folds + k[1]: v for k, v in L.spline_knots(spread, ["set_code", "left_out"]).items()}

    def design_of(c: Columns, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        own, partner, flags = L.side_values(c)
        both = np.tile(who, 2)
        targets = np.column_stack([np.concatenate([c[f"{t}_r"][who], c[f"{t}_l"][who]]) for t in L.TARGETS])
        return L.side_design(own[both], partner[both], flags[both], knots[k]), targets

    def products(c: Columns) -> dict[int, np.ndarray]:
        out = {}
        for k in knots:
            who = (c["set_code"] == k // folds) & (c["fold"] != k % folds)
            if who.any():
                out[k] = L.cross_products(*design_of(c, who, k))
        return out

    sums = grouped_sums(narrow, products)
    models = {(k, name): L.solve(v, columns_of(blocks), target, alpha) for k, v in sums.items() for name, blocks in subsets.items()}

    def errors(c: Columns) -> dict[int, np.ndarray]:
        out = {}
        for k in knots:
            who = (c["set_code"] == k // folds) & (c["fold"] == k % folds)
            if who.any():
                design, targets = design_of(c, who, k)
                y = targets[:, L.TARGETS.index(target)]
                part = np.array([who.sum(), *[((y - models[(k, name)].predict(design)) ** 2).sum() / 2 for name in subsets]], dtype=float)
                out[k // folds] = out.get(k // folds, 0.0) + part
        return out

    lines = [(endpoints[e], name, int(v[0]), float(v[1 + i] / v[0])) for e, v in grouped_sums(narrow, errors).items() for i, name in enumerate(subsets)]
    return spark.createDataFrame(lines, "endpoint string, blocks string, units bigint, risk double")


def block_contributions(frame: DataFrame, folds: int, target: str = "nll", alpha: float = 1.0) -> DataFrame:
    """Risk removed by each block when blocks enter in forward and in reverse order."""
    steps = [(name, i, block, "+".join(sorted(order[:i])) or "none", "+".join(sorted(order[:i + 1]))) for name, order in SEQUENCES.items() for i, block in enumerate(order)]
    subsets = {key: (() if key == "none" else tuple(key.split("+"))) for s in steps for key in s[3:]}
    risks = subset_risks(frame, subsets, folds, target, alpha)
    plan = frame.sparkSession.createDataFrame(steps, "sequence string, position int, block string, before string, after string")
    was = risks.select("endpoint", F.col("blocks").alias("before"), F.col("risk").alias("risk_before"))
    now = risks.select("endpoint", F.col("blocks").alias("after"), F.col("risk").alias("risk_after"))
    return was.join(F.broadcast(plan), "before").join(now, ["endpoint", "after"]).select(
        "endpoint", "sequence", "position", "block", "risk_before", "risk_after", (F.col("risk_before") - F.col("risk_after")).alias("removed"))
