"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows, products distributed over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.operators.sums import grouped_sums
from dyadlab.session import cut

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
TASK_BYTES = 1 << 24  # of vectors that a task of a pass works on at least, since a pass is short and there are many
RANK = 1e-12  # singular values below this share of the largest count as none
LONG_MAX = 2**63 - 1


def integer_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(SCALE * entry) + SHIFT as longs, of the rows whose vector is there with finite entries only."""
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return rows.filter(whole).select(F.col(key).alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as an integer matrix, less SHIFT."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(np.unique(sizes)) > 1:
        raise ValueError("vectors must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1) - SHIFT


@dataclass
class FitList:
    """The distinct vectors as blocks of integers in the checkpoint folder, their number and the sums of x - SHIFT."""

    blocks: DataFrame
    n: int
    total: np.ndarray
    tasks: int  # that hold blocks

    @property
    def width(self) -> int:
        return len(self.total)

    def passes(self, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``compute(centred rows)`` over all rows; each task sends one vector."""
        n, total, width = self.n, self.total, self.width

        def one(columns: dict) -> dict[int, np.ndarray]:
            parts = [compute((n * x - total) / n) for x in (np.frombuffer(b, np.int64).reshape(-1, width) for b in columns["block"])]
            return {0: sum(parts)}

        return grouped_sums(self.blocks.select("block"), one, self.tasks).get(0)


def fit_list(x: DataFrame) -> FitList:
    """Each distinct vector of ``x`` once. A vector that is a third of all rows is folded before the shuffle (partial distinct)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                m = _matrix(batch.column(0).slice(at, BLOCK_ROWS))
                peak = int(np.abs(m).max()) if m.size else 0
                if len(m) * peak > LONG_MAX:
                    raise OverflowError("entries too large for sums of longs")
                out = [pa.array([len(m)], pa.int64()), pa.array([m.shape[1]], pa.int32()), pa.array([peak], pa.int64()), pa.array([m.sum(0).tolist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["rows", "width", "peak", "sums", "block"])

    distinct = cut(x.select("x").distinct())
    size = distinct.agg(F.sum(F.size("x").cast("long") * 8)).first()[0] or 0
    blocks = cut(distinct.coalesce(-(-size // TASK_BYTES) or 1).mapInArrow(pack, "rows long, width int, peak long, sums array<long>, block binary"))
    per_dimension = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()  # one line a dimension
    shape = blocks.withColumn("task", F.spark_partition_id()).agg(F.sum("rows").alias("n"), F.min("width").alias("least"), F.max("width").alias("most"), F.max("peak").alias("peak"), F.count_distinct("task").alias("tasks")).first()
    if shape["least"] != shape["most"]:
        raise ValueError("vectors must have one length")
    n = shape["n"] or 0
    if 2 * n * (shape["peak"] or 0) > LONG_MAX:  # bounds n * x - S and every sum
        raise OverflowError("entries too large for sums of longs")
    return FitList(blocks, n, np.array([int(r["s"]) for r in per_dimension], np.int64), shape["tasks"])


@dataclass
class Spectrum:
    vectors: np.ndarray  # one unit component per line
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float
    steps: int


def bidiagonalise(fit: FitList, components: int = COMPONENTS, seed: int = 7) -> Spectrum:
    """Leading eigenpairs of the covariance from the singular values of the centred rows X.

    Golub-Kahan-Lanczos: u_j ~ X v_j - beta u_(j-1), v_(j+1) ~ X'u_j - alpha v_j. A step is one pass over the rows, which forms
    z = X y row by row, and the sums z'z and X'z. Left vectors stay implicit, u = X c with c on the driver, so they are
    reorthogonalised against all earlier ones through u_k'z = c_k'(X'z) without being stored; right vectors are reorthogonalised
    in full, twice. Where a remainder vanishes, the process goes on from a new direction orthogonal to all so far, so equal
    singular values are all found. It ends when the bidiagonal matrix holds all of the squared norm of X but for less than the
    square of the last wanted singular value, all wanted triplets have converged, or all dimensions are used up.
    """
    d, n = fit.width, fit.n
    if not d or n < 2:
        return Spectrum(np.zeros((0, d)), np.zeros(0), 0.0, 0)
    mass = float(fit.passes(lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0])
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v
    left: list[np.ndarray] = []  # c, with u = X c
    back: list[np.ndarray] = []  # X'u
    alpha, beta = [], []
    tiny = RANK * np.sqrt(mass) if mass > 0 else 0.0

    def fresh() -> np.ndarray | None:
        for _ in range(3):
            v = rng.standard_normal(d)
            for _ in range(2):
                for w in right:
                    v -= (w @ v) * w
            if np.linalg.norm(v) > 1e-8:
                return v / np.linalg.norm(v)
        return None

    v, carried = fresh(), 0.0
    while v is not None and len(right) < d and mass > 0:
        right.append(v)
        y = v - carried * left[-1] if carried else v.copy()
        for _ in range(2):  # the second pass is only run where the first lost digits
            sums = fit.passes(lambda x, y=y: np.concatenate([[np.einsum("i,i->", z := x @ y, z)], z @ x]))
            squared, product = sums[0], sums[1:]
            before = squared
            for c, p in zip(left, back):
                h = c @ product
                y, product, squared = y - h * c, product - h * p, squared - h * h
            if squared > 0.5 * before:
                break
        a = np.sqrt(max(squared, 0.0))
        if a > tiny:
            left.append(y / a)
            back.append(product / a)
            remainder = product / a - a * v
        else:  # v adds nothing that is not already spanned
            a = 0.0
            left.append(np.zeros(d))
            back.append(np.zeros(d))
            remainder = np.zeros(d)
        alpha.append(a)
        for _ in range(2):
            for w in right:
                remainder -= (w @ remainder) * w
        b = float(np.linalg.norm(remainder))
        v, carried = (remainder / b, b) if b > tiny else (fresh(), 0.0)
        k = len(alpha)
        if k >= min(components, d):
            p, s, _ = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
            rest = mass - float(s @ s)
            m = min(components, k) - 1
            if rest < 0.5 * s[m] ** 2 and carried * np.abs(p[-1, : m + 1]).max() <= 1e-14 * s[0]:
                break
        beta.append(carried)
    k = len(alpha)
    if not k:
        return Spectrum(np.zeros((0, d)), np.zeros(0), 0.0, 0)
    _, s, turned = np.linalg.svd(np.diag(alpha) + np.diag(beta[: k - 1], 1))
    vectors = turned @ np.array(right)
    use = (np.arange(k) < components) & (s > RANK * s[0])
    vectors, s = vectors[use], s[use]
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return Spectrum(vectors, s * s / n, mass / n, k)


def identity_error(fit: FitList, spectrum: Spectrum) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(spectrum.values)
    weights = (spectrum.vectors / np.sqrt(spectrum.values)[:, None]).T
    if not k:
        return 0.0
    mean = fit.passes(lambda x: (x @ weights).sum(0)) / fit.n

    def products(x: np.ndarray) -> np.ndarray:
        w = x @ weights - mean
        return (w.T @ w).ravel()

    return float(np.abs(fit.passes(products).reshape(k, k) / fit.n - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One line per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null, NaN or infinite entries are left out; null and repeated ids keep their lines (the id
    keeps its type). Only components with a deviation are given: equal vectors alone, an empty table or a single vector give no
    lines. Equal eigenvalues give some orthonormal basis of their space. Vectors of different lengths fail, as do entries whose
    sums or deviations do not fit a long. Other columns are not read. Of the fit only its sums, the components and one small
    matrix reach the driver; vectors stay in tasks.
    """
    x = integer_rows(rows, key, vector)
    fit = fit_list(x)
    spectrum = bidiagonalise(fit, components)
    error = identity_error(fit, spectrum)
    n, total, k = fit.n, fit.total, len(spectrum.values)
    weights = (spectrum.vectors / np.sqrt(spectrum.values)[:, None]).T
    explained = spectrum.values / spectrum.trace if k else spectrum.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            moved = n * _matrix(batch.column(1)) - total
            if len(total) * int(np.abs(moved).max()) ** 2 > LONG_MAX:
                raise OverflowError("deviations do not fit a long")
            out, size = (moved / n) @ weights, len(moved)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(size), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)),
                    pa.array(np.repeat((moved * moved).sum(1), k)), pa.array(out.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.select(key).schema[0].dataType.simpleString()
    return x.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
