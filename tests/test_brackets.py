"""Bracket search for quantiles of overlapping subsets against NumPy."""

import numpy as np
import pytest

from dyadlab.operators import brackets as K
from dyadlab.operators import lossmodel as L

PROBS = [0.0, 0.25, 0.5, 0.731, 1.0]


def overlapping():
    """A function of a function, so that tasks get it by value."""
    return lambda c: {k: c["z"][(c["g"] % 4 != k) & (c["g"] >= 0)] for k in range(5)} | {9: c["z"][c["g"] == -1]}


def test_order_of_bits_is_that_of_doubles():
    v = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    bits = K.ordered_bits(v)
    assert (np.diff(bits) >= 0).all() and bits[4] == bits[5] and (np.diff(bits)[[i for i in range(10) if i != 4]] > 0).all()
    assert (K.doubles(bits) == v).all()


@pytest.mark.parametrize("few", [1, 7, 512])
@pytest.mark.parametrize("kind", ["normal", "tied", "wide", "constant"])
def test_quantiles_of_all_subsets(spark, monkeypatch, few, kind):
    monkeypatch.setattr(K, "FEW", few)
    r = np.random.default_rng(3)
    n = 900
    z = {"normal": r.standard_normal(n), "tied": r.integers(-2, 3, n).astype(float), "wide": r.standard_normal(n) * 10.0 ** r.integers(-200, 200, n), "constant": np.full(n, -0.25)}[kind]
    z[5], z[6] = np.nan, z[7]
    g = r.integers(-1, 4, n)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, z)], "g int, z double").repartition(5)
    subsets = overlapping()
    got = K.subset_quantiles(df, subsets, PROBS)
    for k, v in subsets({"g": g, "z": z}).items():
        v = v[~np.isnan(v)]
        np.testing.assert_allclose(got[k], np.quantile(v, PROBS), rtol=1e-15, atol=0)


def test_single_values_infinities_and_nothing(spark):
    df = spark.createDataFrame([(0, 2.0), (1, float("inf")), (1, float("-inf")), (1, 3.0), (2, float("nan"))], "g int, z double")
    got = K.subset_quantiles(df, lambda c: {k: c["z"][c["g"] == k] for k in (0, 1, 2, 3)}, [0.0, 0.5, 1.0])
    assert got.keys() == {0, 1} and got[0].tolist() == [2.0] * 3 and got[1].tolist() == [-np.inf, 3.0, np.inf]
    assert K.subset_quantiles(df.filter("false"), lambda c: {0: c["z"]}, [0.5]) == {}


def test_subset_knots_equal_sorted_ones(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(r.standard_normal((400, 2)))], "fold int, z_r double, z_l double")
    sorted_ = L.spline_knots(df, ["fold"])
    found = L.subset_knots(df, ["fold"], lambda c: {f: c["fold"] == f for f in range(3)})
    for f in range(3):
        np.testing.assert_allclose(found[f], sorted_[f,], rtol=1e-15)
