"""Many small smooth fits advanced together, so that one pass over the data evaluates all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

NOISE = 1e-12  # sums over many rows are added in varying order; a smaller difference of losses means nothing

# fit number -> (loss, gradient, Hessian or None), all per training row
Evaluation = dict[int, tuple[float, np.ndarray, np.ndarray | None]]


@dataclass
class Fit:
    x: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    hessian: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    memory: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    converged: bool = False
    stalled: bool = False


def _free(fit: Fit, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Parameters not pinned at a bound by an outward-pointing gradient."""
    return ~(((fit.x <= low) & (fit.gradient > 0)) | ((fit.x >= high) & (fit.gradient < 0)))


def _direction(fit: Fit, free: np.ndarray) -> np.ndarray:
    g = fit.gradient
    if fit.hessian is not None:  # Newton on the free parameters
        d = np.zeros_like(g)
        h = fit.hessian[np.ix_(free, free)]
        d[free] = -np.linalg.solve(h + 1e-12 * np.eye(len(h)) * max(1.0, np.trace(h)), g[free])
        return d if d @ g < 0 else -g
    q = g.copy()  # limited-memory quasi-Newton
    stack = []
    for s, y in reversed(fit.memory):
        a = s @ q / (s @ y)
        q -= a * y
        stack.append((a, s, y))
    if fit.memory:
        s, y = fit.memory[-1]
        q *= s @ y / (y @ y)
    for a, s, y in reversed(stack):
        q += s * (a - y @ q / (s @ y))
    return -q if q @ g > 0 else -g


def minimise(
    starts: dict[int, np.ndarray], evaluate: Callable[[dict[int, np.ndarray]], Evaluation], *,
    tolerance: float = 1e-8, passes: int = 200, low: np.ndarray | None = None, high: np.ndarray | None = None, history: int = 10,
) -> dict[int, Fit]:
    """Minimise every fit; ``evaluate`` is called once per pass with the trial points still open."""
    fits = {k: Fit(np.asarray(x, dtype=float)) for k, x in starts.items()}
    size = len(next(iter(starts.values())))
    low = np.full(size, -np.inf) if low is None else low
    high = np.full(size, np.inf) if high is None else high
    trial = {k: f.x for k, f in fits.items()}
    for _ in range(passes):
        if not trial:
            break
        results, following = evaluate(trial), {}
        for k, point in trial.items():
            fit = fits[k]
            loss, gradient, hessian = results[k]
            moved = point - fit.x
            enough = fit.gradient is None or loss <= fit.loss + 1e-4 * min(0.0, fit.gradient @ moved) + NOISE * (1 + abs(fit.loss))
            if enough:
                if fit.gradient is not None and fit.hessian is None and hessian is None:
                    change = gradient - fit.gradient
                    if moved @ change > 1e-14:
                        fit.memory = [*fit.memory, (moved, change)][-history:]
                fit.x, fit.loss, fit.gradient, fit.hessian, fit.step = point, loss, gradient, hessian, 1.0
                free = _free(fit, low, high)
                if not free.any() or np.max(np.abs(gradient[free])) < tolerance:
                    fit.converged = True
                    continue
                fit.direction = _direction(fit, free)
                if fit.hessian is None and not fit.memory:
                    fit.step = min(1.0, 1.0 / max(1e-12, np.linalg.norm(gradient)))
            else:
                fit.step *= 0.5
                if fit.step < 1e-10:
                    fit.stalled = True
                    continue
            following[k] = np.clip(fit.x + fit.step * fit.direction, low, high)
        trial = following
    return fits
