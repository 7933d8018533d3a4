"""L2 logistic heads on feature arrays: every training set, strength and endpoint fitted in the same passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from dyadlab.operators.lockstep import minimise
from dyadlab.operators.sums import Columns, grouped_sums, map_columns
from dyadlab.session import cut

STRENGTHS = (0.01, 0.1, 1.0, 10.0)
NEWTON_LIMIT = 2_000_000  # second derivatives are collected (about eight passes) while they fit in 16 MB, else only gradients


@dataclass(frozen=True)
class TrainingSet:
    """All units (assessed is None), those outside an outer fold, or those also outside one of its inner folds."""

    assessed: int | None = None
    left_out: int | None = None

    def mask(self, c: Columns) -> np.ndarray:
        rows = len(c["outer_fold"])
        if self.assessed is None:
            return np.ones(rows, dtype=bool)
        keep = c["outer_fold"] != self.assessed
        return keep if self.left_out is None else keep & (c["inner"][:, self.assessed] != self.left_out)


def nested_sets(folds: int, inner: int) -> list[TrainingSet]:
    return [TrainingSet(), *[TrainingSet(o) for o in range(folds)], *[TrainingSet(o, i) for o in range(folds) for i in range(inner)]]


@dataclass
class Head:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # on the standardised scale
    intercept: float
    converged: bool

    def raw(self) -> tuple[np.ndarray, float]:
        """Coefficients and intercept on the original features."""
        w = self.weight / self.scale
        return w, self.intercept - float(w @ self.mean)


def feature_moments(df: DataFrame, sets: Sequence[TrainingSet]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, mean and population deviation of every feature per training set (a constant feature gets scale one)."""

    def compute(c: Columns) -> dict[int, np.ndarray]:
        out = {}
        for k, s in enumerate(sets):
            keep = s.mask(c)
            x = np.concatenate([c["x_r"][keep], c["x_l"][keep]])
            out[k] = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        return out

    result = {}
    for k, v in grouped_sums(df.select("outer_fold", "inner", "x_r", "x_l"), compute).items():
        p = (len(v) - 1) // 2
        mean = v[1:1 + p] / v[0]
        sd = np.sqrt(np.maximum(v[1 + p:] / v[0] - mean * mean, 0.0))
        result[k] = (v[0], mean, np.where(sd > 1e-12 * (1 + np.abs(mean)), sd, 1.0))
    return result


Task = tuple[int, int, float]  # endpoint number, training-set number, strength C


def fit_heads(df: DataFrame, sets: Sequence[TrainingSet], endpoints: int, strengths: Sequence[float] = STRENGTHS, tolerance: float = 1e-7) -> dict[Task, Head]:
    """Minimise C * sum(log loss) + |w|^2 / 2 for every task; ``df`` holds outer_fold, inner, x_r, x_l, y_r, y_l."""
    moments = feature_moments(df, sets)
    tasks: list[Task] = [(e, k, float(c)) for k in range(len(sets)) for e in range(endpoints) for c in strengths]
    narrow = cut(df.select("outer_fold", "inner", "x_r", "x_l", "y_r", "y_l"))  # read once per pass
    width = narrow.rdd.getNumPartitions()
    p = len(moments[0][1])

    newton = len(tasks) * (p + 1) ** 2 <= NEWTON_LIMIT

    def evaluate(points):
        by_set: dict[int, list[int]] = {}
        for t in points:
            by_set.setdefault(tasks[t][1], []).append(t)
        packed = {k: (np.stack([points[t] for t in members], axis=1), np.array([tasks[t][0] for t in members]), *moments[k][1:]) for k, members in by_set.items()}

        def compute(c: Columns) -> dict[int, np.ndarray]:
            out = {}
            for k, members in by_set.items():
                keep = sets[k].mask(c)
                if not keep.any():
                    continue
                w, e, mean, scale = packed[k]
                x = np.concatenate([c["x_r"][keep], c["x_l"][keep]])
                x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
                y = np.concatenate([c["y_r"][keep], c["y_l"][keep]])[:, e]
                z = x @ w
                prob = 1.0 / (1.0 + np.exp(-z))
                loss = (np.logaddexp(0.0, z) - y * z).sum(0)
                gradient = x.T @ (prob - y)
                for j, t in enumerate(members):
                    curve = ((x * (prob[:, j] * (1 - prob[:, j]))[:, None]).T @ x).ravel() if newton else []
                    out[t] = np.concatenate([[loss[j]], gradient[:, j], curve])
            return out

        results = {}
        for t, v in grouped_sums(narrow, compute, width).items():
            _, k, strength = tasks[t]
            rows, x = moments[k][0], points[t]
            penalty = np.append(np.full(p, 1.0 / strength), 0.0)
            hessian = (v[p + 2:].reshape(p + 1, p + 1) + np.diag(penalty)) / rows if newton else None
            results[t] = ((v[0] + x @ (penalty * x) / 2) / rows, (v[1:p + 2] + penalty * x) / rows, hessian)
        return results

    fits = minimise({t: np.zeros(p + 1) for t in range(len(tasks))}, evaluate, tolerance=tolerance)
    return {task: Head(moments[task[1]][1], moments[task[1]][2], fits[t].x[:p], float(fits[t].x[p]), fits[t].converged) for t, task in enumerate(tasks)}


def score_folds(df: DataFrame, heads: dict[Task, Head], sets: Sequence[TrainingSet], endpoints: int, strengths: Sequence[float], folds: int, keep: list[str], keep_schema: str) -> DataFrame:
    """Out-of-fold scores of both sides: for the unit's own outer fold from the head trained without it, for the
    other outer folds from the inner head that left the unit out. Array order: endpoint, outer fold, strength."""
    index = {(s.assessed, s.left_out): k for k, s in enumerate(sets)}
    order = [(e, o, c) for e in range(endpoints) for o in range(folds) for c in strengths]
    table = {}
    for (e, k, c), head in heads.items():
        table[(e, sets[k].assessed, sets[k].left_out, c)] = head.raw()
    lefts = sorted({s.left_out for s in sets if s.left_out is not None})

    def compute(c: Columns) -> Columns:
        rows = len(c["outer_fold"])
        out = {"score_r": np.empty((rows, len(order))), "score_l": np.empty((rows, len(order)))}
        for j, (e, o, strength) in enumerate(order):
            for left in [None, *lefts]:
                if (o, left) not in index:
                    continue
                who = c["outer_fold"] == o if left is None else (c["outer_fold"] != o) & (c["inner"][:, o] == left)
                w, b = table[(e, o, left, strength)]
                for s in "rl":
                    out[f"score_{s}"][who, j] = c[f"x_{s}"][who] @ w + b
        return out

    needed = df.select(*dict.fromkeys([*keep, "outer_fold", "inner", "x_r", "x_l"]))
    return map_columns(needed, compute, keep, f"{keep_schema}, score_r array<double>, score_l array<double>")
