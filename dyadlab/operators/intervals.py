"""Intervals of every risk contrast and stratum from one run: strata overlap, unit weights are shared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.pairs import UNIT
from dyadlab.operators.resample import bca_interval
from dyadlab.operators.risk import square
from dyadlab.operators.tree_bootstrap import within
from dyadlab.session import PART_ROWS, dealt

KEYS = ["family", "endpoint", "level"]
SPARSE_BELOW = 10


def _line(family: str, level: Column | str, value: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), (F.lit(level) if isinstance(level, str) else level).alias("level"), value.cast("double").alias("value"))


def stratum_units(rows: DataFrame, first: str, second: str, qualities: Sequence[str] = ("q1", "q2")) -> DataFrame:
    """(family, endpoint, level, unit, value): the unit means of all contrasts, one line per unit and stratum it falls in.

    Families: ``contrast`` (levels nll, brier, mae), ``state``, ``quality`` (own level), ``direction`` (own x partner), ``device`` (pair of
    devices), all of the gain of the augmented loss model; ``asymmetry`` and ``oriented`` (score differences by state). One row
    makes all its lines where the rows of its unit are, so the strata cost a single shuffle of the rows, whose partitions follow their number.
    """
    gain = lambda t, f: f(F.col(t) - F.col(f"predicted_{t}_r0")) - f(F.col(t) - F.col(f"predicted_{t}_r1"))
    nll, right = gain("nll", square), F.col("side") == 1
    state = F.when(right, S.pair_state(F.col("label"), F.col("partner_label"))).otherwise(S.pair_state(F.col("partner_label"), F.col("label")))
    gap = F.when(right, F.col("z") - F.col("partner_z")).otherwise(F.col("partner_z") - F.col("z"))
    own = lambda q: F.when(F.col(q) == S.NORMAL, "normal").when(F.col(q) == S.ABNORMAL, "abnormal")
    lines = [
        _line("contrast", "nll", nll), _line("contrast", "brier", gain("brier", square)), _line("contrast", "mae", gain("nll", F.abs)),
        _line("state", state, nll), _line("device", S.device_pair(F.col("device"), F.col("partner_device"), first, second), nll),
        *[_line("quality", F.concat(F.lit(f"{q}/"), own(q)), nll) for q in qualities],
        *[_line("direction", F.concat(F.lit(f"{q}/"), S.directional_stratum(F.col(q), F.col(f"partner_{q}"))), nll) for q in qualities],
        _line("asymmetry", state, gap),
        _line("oriented", F.when(state.isin("10", "01"), state), F.when(state == "10", gap).when(state == "01", -gap)),
    ]
    used = ["side", "label", "partner_label", "z", "partner_z", "device", "partner_device", "nll", *[f"predicted_{t}_{r}" for t in ("nll", "brier") for r in ("r0", "r1")], "brier", *qualities, *[f"partner_{q}" for q in qualities]]
    spread = dealt(rows.select("endpoint", UNIT, *used), UNIT, rows=PART_ROWS // len(lines))
    long = spread.select("endpoint", UNIT, F.explode(F.array(*lines)).alias("_l")).select("endpoint", UNIT, "_l.*").filter("level IS NOT NULL")
    return long.groupBy(*KEYS, UNIT).agg(F.avg("value").alias("value"))


def stratum_intervals(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """BCa intervals of the mean of every stratum of :func:`stratum_units`, with method, eligibility and a flag of sparse strata.

    All units are resampled together and a stratum's mean is that of its units under their weights, so the strata of one
    replicate belong together and their number does not multiply the draws.
    """
    found = bca_interval(units, "value", replicates, [seed], KEYS, resample=within())
    flag = F.when(F.col("units") < SPARSE_BELOW, "very_sparse_descriptive").otherwise("estimable")
    return found.drop("seed").withColumn("precision_flag", flag)
