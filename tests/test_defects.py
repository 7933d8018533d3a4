"""Defects that were mended: seals, ragged vectors, missing endpoints, keys without values."""

import numpy as np
import pyarrow as pa
import pytest


def test_seal_sees_moved_nulls_and_repeats(spark):
    from dyadlab.sources.sinks import ledger_mismatches, table_ledger

    kinds = "a int, b int"
    first = table_ledger({"t": spark.createDataFrame([(None, 5), (1, 2)], kinds)})
    moved = table_ledger({"t": spark.createDataFrame([(5, None), (1, 2)], kinds)})
    same = table_ledger({"t": spark.createDataFrame([(1, 2), (None, 5)], kinds)})
    assert ledger_mismatches(moved, first).count() == 1
    assert ledger_mismatches(same, first).count() == 0


def test_ragged_vectors_fail():
    from dyadlab.operators.sums import batch_columns

    good = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0], [3.0, 4.0]])], names=["x"])
    assert np.array_equal(batch_columns(good)["x"], [[1, 2], [3, 4]])
    for bad in ([[1.0, 2.0, 3.0], [4.0], [5.0, 6.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            batch_columns(pa.RecordBatch.from_arrays([pa.array(bad, pa.list_(pa.float64()))], names=["x"]))


def test_bca_keeps_keys_without_finite_values(spark):
    from dyadlab.operators.resample import bca_interval

    rows = [(u, "a", float(u)) for u in range(1, 11)] + [(u, "b", float("nan")) for u in range(1, 5)]
    got = {r.endpoint: r for r in bca_interval(spark.createDataFrame(rows, "unit_id long, endpoint string, v double"), "v", 100, [1]).collect()}
    assert got["a"].method == "BCa"
    assert (got["b"].method, got["b"].units, got["b"].lower, got["b"].significance_eligible) == ("not_estimable", 0, None, False)


def test_unpredicted_endpoint_fails_its_checks(spark):
    from dyadlab.operators.gates import validation_checks

    rows = [(u, s, "p", 0, 1, 0.5, 0.6931471805599453, "m", 1.0) for u in (1, 2) for s in (1, 2)]
    predictions = spark.createDataFrame(rows, "unit_id long, side int, endpoint string, outer_fold int, label int, prob double, nll double, method string, strength double")
    folds = spark.createDataFrame([(1, 0), (2, 0)], "unit_id long, outer_fold int")
    checks = validation_checks(predictions, folds, folds.select("unit_id").limit(0), endpoints=["p", "q"]).collect()
    assert all(c.passed for c in checks if c.endpoint == "p")
    assert len([c for c in checks if c.endpoint == "q"]) == 5 and not any(c.passed for c in checks if c.endpoint == "q")
