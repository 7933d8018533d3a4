"""Leakage without draws, encodings that keep rows apart, pairs that must be complete."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_expected_leakage_agrees_with_simulated_splits(spark):
    from dyadlab.operators.audit import expected_row_leakage

    sizes = [1] * 30 + [2] * 20 + [3] * 10 + [7] * 2 + [40]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows = spark.createDataFrame([(int(u),) for u in owner] + [(None,)] * 5, "unit_id long")
    got = expected_row_leakage(rows).first()
    rng, n = np.random.default_rng(3), len(owner)
    part = np.repeat([0, 1, 2], [round(0.7 * n), round(0.15 * n), n - round(0.7 * n) - round(0.15 * n)])
    seen = []
    for _ in range(10_000):
        split = rng.permutation(part)
        held = np.zeros((len(sizes), 3), bool)
        held[owner, split] = True
        seen.append((held.sum(1) > 1).sum())
    assert (got["rows"], got["units"]) == (n, len(sizes))
    assert abs(got.expected - np.mean(seen)) < 5 * np.std(seen) / 100 and abs(got.deviation / np.std(seen) - 1) < 0.04


def test_expected_leakage_of_a_hot_unit_and_of_nothing(spark):
    from dyadlab.operators.audit import expected_row_leakage

    hot = spark.range(30_000).select(F.when(F.col("id") < 10_000, -1).otherwise(F.col("id")).alias("unit_id"))
    got = expected_row_leakage(hot).first()
    assert (got["rows"], got["units"], got.expected) == (30_000, 20_001, 1.0) and got.deviation < 0.01
    none = expected_row_leakage(hot.limit(0)).first()
    assert (none["rows"], none["units"], none.expected, none.deviation) == (0, 0, None, None)


def test_unlike_rows_have_unlike_digests(spark):
    from dyadlab.functions import scalars as S
    from dyadlab.operators.cohort import content_hash

    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "b|c"), (None, "c"), ("\\N", "c"), ("", "c"), ("c", None), ("c", "")]
    frame = lambda r: spark.createDataFrame([r], "x string, y string")
    assert len({content_hash(frame(r), ["x", "y"]).first()["content_hash"] for r in rows}) == len(rows)
    assert len({frame(r).select(S.keyed_digest(7, F.col("x"), F.col("y"))).first()[0] for r in rows}) == len(rows)


def test_strict_pairs_name_the_incomplete_unit(spark):
    from dyadlab.operators.pairs import pair_wide

    good = [(1, 1, 5), (1, 2, 6), (2, 1, 7), (2, 2, 8)]
    kinds = "unit_id int, side int, v int"
    assert pair_wide(spark.createDataFrame(good, kinds), ["v"], strict=True).count() == 2
    for bad in ([(3, 1, 9)], [(3, 1, 9), (3, 1, 9)], [(3, 1, 9), (3, 2, 9), (3, 2, 9)], [(3, 1, 9), (3, 3, 9)]):
        rows = spark.createDataFrame(good + bad, kinds)
        assert pair_wide(rows, ["v"]).count() == 2
        with pytest.raises(Exception, match="exactly one row a side: 3"):
            pair_wide(rows, ["v"], strict=True).collect()
