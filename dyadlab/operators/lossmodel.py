"""Loss-prediction ridge models on spline bases of the own and the partner's logit.

One pass collects the cross-products of all design columns per training set; every strength, target and model is
solved from those small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.brackets import subset_quantiles
from dyadlab.operators.ordering import exact_quantiles

# Fixed values.
DEGREE, KNOTS = 3, 5
ALPHAS = (0.0, 0.01, 0.1, 1.0, 10.0)
NLL_LIMIT = 13.815510557964274
TARGETS, MODELS = ("nll", "brier"), ("r0", "r1")
INDICATORS = ("q1_abnormal", "q2_abnormal", "q2_unevaluable", "side_right", "device_second")
BASIS = KNOTS + DEGREE - 2  # columns left after dropping the last one

OWN = tuple(f"own_spline_{i}" for i in range(BASIS))
PARTNER = tuple(f"partner_spline_{i}" for i in range(BASIS))
DESIGN = ("intercept", *OWN, *INDICATORS, *PARTNER)


def design_columns(augmented: bool) -> tuple[str, ...]:
    return (*OWN, *INDICATORS, *(PARTNER if augmented else ()))


def spline_basis(z: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic B-spline basis on quantile knots, continued linearly beyond the end knots, last column dropped.

    Basis functions come from the usual two-term recursion on the knot vector extended by the end spacings; a
    repeated knot gives an empty interval whose terms are taken as zero.
    """
    knots = np.asarray(knots, dtype=float)
    steps = np.arange(DEGREE, 0, -1)
    full = np.concatenate([knots[0] - steps * (knots[1] - knots[0]), knots, knots[-1] + steps[::-1] * (knots[-1] - knots[-2])])
    low, high = knots[0], knots[-1]
    inside = np.clip(z, low, high)

    def ratio(top, bottom):
        return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)

    # degree zero: intervals closed on the left; the last real interval also on the right
    last = max(np.flatnonzero(full[:-1] < high))
    b = ((inside[:, None] >= full[:-1]) & (inside[:, None] < full[1:])).astype(float)
    at_end = inside >= high
    b[at_end] = 0.0
    b[at_end, last] = 1.0
    lower = b
    for d in range(1, DEGREE + 1):
        left, right = full[: -d - 1], full[d + 1:]
        rise = ratio(inside[:, None] - left, np.broadcast_to(full[d:-1] - left, (len(z), len(left))))
        fall = ratio(right - inside[:, None], np.broadcast_to(right - full[1:-d], (len(z), len(left))))
        lower, b = b, rise * b[:, :-1] + fall * b[:, 1:]
    # slope of the cubic basis from the quadratic one
    w0, w1 = full[DEGREE:-1] - full[: -DEGREE - 1], full[DEGREE + 1:] - full[1:-DEGREE]
    shape = (len(z), b.shape[1])
    slope = DEGREE * (ratio(lower[:, :-1], np.broadcast_to(w0, shape)) - ratio(lower[:, 1:], np.broadcast_to(w1, shape)))
    return (b + (z - inside)[:, None] * slope)[:, :-1]


def side_design(own: np.ndarray, partner: np.ndarray, indicators: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(own)), spline_basis(own, knots), indicators, spline_basis(partner, knots)])


@dataclass
class LossModel:
    """Coefficients over ``DESIGN`` (zero for columns not in the model) for raw spline columns."""

    alpha: float
    target: str
    beta: np.ndarray

    def predict(self, design: np.ndarray) -> np.ndarray:
        return np.clip(design @ self.beta, 0.0, NLL_LIMIT if self.target == "nll" else 1.0)


def cross_products(design: np.ndarray, targets: np.ndarray) -> np.ndarray:
    full = np.column_stack([design, targets])
    return (full.T @ full).ravel()


def solve(products: np.ndarray, columns: Sequence[str], target: str, alpha: float) -> LossModel:
    """Ridge with an unpenalised intercept on any subset of the design columns; spline columns are standardised
    (population SD, constant -> scale one)."""
    width = len(DESIGN) + len(TARGETS)
    g = products.reshape(width, width)
    n = g[0, 0]
    names = list(columns)
    at = np.array([DESIGN.index(c) for c in names], dtype=int)
    y = len(DESIGN) + TARGETS.index(target)
    mean, mean_y = g[0, at] / n, g[0, y] / n
    centred = g[np.ix_(at, at)] - n * np.outer(mean, mean)
    with_y = g[at, y] - n * mean * mean_y
    spline = np.array(["spline" in c for c in names], dtype=bool)
    sd = np.sqrt(np.maximum(np.diag(centred) / n, 0.0))
    scale = np.where(spline & (sd > 1e-12 * (1 + np.abs(mean))), sd, 1.0)
    a = centred / np.outer(scale, scale) + alpha * np.eye(len(at))
    w = (np.linalg.lstsq(a, with_y / scale, rcond=1e-12)[0] if alpha == 0 else np.linalg.solve(a, with_y / scale)) / scale
    beta = np.zeros(len(DESIGN))
    beta[at] = w
    beta[0] = mean_y - w @ mean
    return LossModel(alpha, target, beta)


def side_values(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wide pair columns (z_r, z_l, flags_r, flags_l) to (own, partner, indicators) with side R first, then L."""
    own = np.concatenate([c["z_r"], c["z_l"]])
    partner = np.concatenate([c["z_l"], c["z_r"]])
    return own, partner, np.concatenate([c["flags_r"], c["flags_l"]])


def indicator_arrays(pairs: DataFrame, second_device: str) -> DataFrame:
    """Adds flags_r and flags_l, the indicator block of each side as an array."""
    return pairs.withColumns({
        f"flags_{s}": F.array(*S.indicator_columns(F.col(f"q1_{s}"), F.col(f"q2_{s}"), F.lit(1 if s == "r" else 2), F.col(f"device_{s}"), second_device).values())
        for s in "rl"})


def spline_knots(pairs: DataFrame, keys: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Exact quantile knots of the logits of both sides per key. Own and partner logits are the same values, so they
    share their knots."""
    z = pairs.select(*keys, F.explode(F.array("z_r", "z_l")).alias("z"))
    names = {f"k{i}": i / (KNOTS - 1) for i in range(KNOTS)}
    return {tuple(r[k] for k in keys): np.array([r[n] for n in names]) for r in exact_quantiles(z, "z", names, keys).collect()}


def subset_knots(frame: DataFrame, columns: Sequence[str], members: Callable[[dict[str, np.ndarray]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The knots of :func:`spline_knots` for overlapping subsets of wide lines, without a line per subset: ``members(batch)`` gives the
    mask of each subset that has lines in the batch. ``frame`` is read a few times, so store it."""

    def values(c: dict[str, np.ndarray]) -> dict[int, np.ndarray]:
        return {k: np.concatenate([c["z_r"][who], c["z_l"][who]]) for k, who in members(c).items()}

    return subset_quantiles(frame.select(*columns, "z_r", "z_l"), values, [i / (KNOTS - 1) for i in range(KNOTS)])
