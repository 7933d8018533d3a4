"""Tree bootstrap against weights written out unit by unit, and weighted rankings against copied rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlab.operators import ranked_bootstrap as R
from dyadlab.operators import resample as B
from dyadlab.operators import tree_bootstrap as T


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_UNITS", 8)  # several blocks and levels in a small table
    return T


@pytest.fixture(scope="module")
def lines(spark):
    """Overlapping strata of 90 units, and a unit that a stratum lacks."""
    r = np.random.default_rng(2)
    rows = [(s, i, float(v)) for i, v in enumerate(r.exponential(size=90)) for s in ("all", "odd" if i % 2 else "even", "third") if s != "third" or i % 3 == 0]
    return spark.createDataFrame(rows, "endpoint string, unit_id long, v double")


def all_weights(spark, units, replicates, seed):
    """{unit: counts} read back as the weighted mean of one unit's indicator."""
    rows = spark.createDataFrame([(str(u), u, 1.0) for u in units], "endpoint string, unit_id long, v double")
    out = {u: np.zeros(replicates) for u in units}
    for r in T.resampled_sums(rows, "v", replicates, [seed], ["endpoint"]).collect():
        sums = np.frombuffer(r["_sums"], np.float64).reshape(T.SLICE, 2)[:, 0]
        first = r["_part"] * T.SLICE
        out[int(r["endpoint"])][first : first + T.SLICE] = sums[: max(0, replicates - first)]
    return out


def test_weights_are_multinomial(spark, small):
    w = np.array(list(all_weights(spark, range(90), 2000, 5).values()))
    assert (w.sum(0) == 90).all() and (w == np.round(w)).all() and w.min() >= 0
    assert abs(w.mean() - 1) < 1e-12
    assert np.abs(w.mean(1) - 1).max() < 5 * np.sqrt(1 / 2000)  # every unit is as likely
    assert np.abs(w.var(1) - (1 - 1 / 90)).max() < 0.25
    pairs = np.corrcoef(w)[np.triu_indices(90, 1)]
    assert abs(pairs.mean() + 1 / 89) < 2e-3  # multinomial counts are correlated by -1/(n-1)


def test_means_follow_the_weights_in_every_overlapping_stratum(spark, small, lines):
    w = all_weights(spark, range(90), 700, 11)
    want = {}
    for s in ("all", "odd", "even", "third"):
        mine = [(r["unit_id"], r["v"]) for r in lines.filter(F.col("endpoint") == s).collect()]
        want[s] = sum(w[u] * v for u, v in mine) / sum(w[u] for u, _ in mine)
    got = T.resampled_means(lines, "v", 700, [11]).collect()
    assert len(got) == 4 * 700
    for r in got:
        assert r["mean"] == pytest.approx(want[r["endpoint"]][r["replicate"]], abs=1e-12)


def test_result_does_not_depend_on_partitions_columns_or_more_replicates(spark, small, lines):
    def found(df, replicates=600):
        return {(r["endpoint"], r["seed"], r["replicate"]): r["mean"] for r in T.resampled_means(df, "v", replicates, [3, 4]).collect()}

    first = found(lines)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = found(lines.repartition(13).orderBy(F.rand(1)))
        longer = found(lines, 1100)
        alone = found(lines.filter("endpoint = 'all'"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert again.keys() == first.keys() and alone.keys() == {k for k in first if k[0] == "all"}
    for k, v in first.items():
        assert again[k] == pytest.approx(v, abs=1e-12) and longer[k] == pytest.approx(v, abs=1e-12)
        assert k[0] != "all" or alone[k] == pytest.approx(v, abs=1e-12)
    assert {k[1] for k in first} == {3, 4} and first["all", 3, 0] != first["all", 4, 0]


def test_populations_keep_their_sizes(spark, small):
    rows = spark.createDataFrame([("a" if i < 25 else "b", i, 1.0) for i in range(90)], "endpoint string, unit_id long, v double")
    for r in T.resampled_sums(rows, "v", 100, [1], ["endpoint"], ["endpoint"]).collect():
        assert set(np.frombuffer(r["_sums"], np.float64).reshape(T.SLICE, 2)[:, 1]) == {25.0 if r["endpoint"] == "a" else 65.0}


def test_bca_with_tree_weights_against_numpy(spark, small, lines):
    from statistics import NormalDist

    x = np.array([r["v"] for r in lines.filter("endpoint = 'all'").orderBy("unit_id").collect()])
    w = all_weights(spark, range(90), 1000, 21)
    means = sum(w[i] * x[i] for i in range(90)) / 90
    nd = NormalDist()
    z0 = nd.inv_cdf(((means < x.mean()).sum() + 0.5 * (means == x.mean()).sum()) / 1000)
    d = x - x.mean()
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    limit = lambda q: np.quantile(means, nd.cdf(z0 + (z0 + nd.inv_cdf(q)) / (1 - a * (z0 + nd.inv_cdf(q)))))
    got = B.bca_interval(lines, "v", 1000, [21], resample=T.within()).filter("endpoint = 'all'").first()
    np.testing.assert_allclose([got["lower"], got["upper"], got["z0"], got["acceleration"]], [limit(0.025), limit(0.975), z0, a], atol=1e-9)


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("a", 1, None), ("a", 2, float("nan")), ("a", 3, 4.0), (None, 3, 5.0)], "endpoint string, unit_id long, v double")
    got = {(r["endpoint"], r["mean"]) for r in T.resampled_means(rows, "v", 20, [1]).collect()}
    assert got == {("a", 4.0), (None, 5.0)}
    assert T.resampled_means(rows.filter("false"), "v", 20, [1]).count() == 0


# ---- weighted rankings


def ranked_rows(spark, n=60, seed=8):
    r = np.random.default_rng(seed)
    rows = [(e, i, side, int(r.random() < 0.4), float(np.round(r.random(), 1 if e == "tied" else 6))) for e in ("tied", "fine") for i in range(n) for side in (1, 2)]
    return rows, spark.createDataFrame(rows, "endpoint string, unit_id long, side int, y int, s double").repartition(5)


def copied(rows, w, b, e):
    return [(s, y, u, side) for x, u, side, y, s in rows if x == e for _ in range(int(w[u][b]))]


def test_weighted_ranking_equals_copied_rows(spark, small, monkeypatch):
    monkeypatch.setattr(R, "SCAN_LINES", 4)  # ties run across stacked lines
    rows, df = ranked_rows(spark)
    w = all_weights(spark, range(60), 40, 9)
    got = {(r["endpoint"], r["replicate"]): r for r in R.replicate_statistics(df, "y", "s", 40, 9).collect()}
    assert len(got) == 80
    for (e, b), r in got.items():
        c = copied(rows, w, b, e)
        p, q = [s for s, y, *_ in c if y], [s for s, y, *_ in c if not y]
        area = sum((a > n) + 0.5 * (a == n) for a in p for n in q) / len(p) / len(q)
        steps = seen = hits = 0
        for s in sorted({x[0] for x in c}, reverse=True):
            here = [y for t, y, *_ in c if t == s]
            hits, seen = hits + sum(here), seen + len(here)
            steps += sum(here) * hits / seen
        assert r["auroc"] == pytest.approx(area, abs=1e-12) and r["average_precision"] == pytest.approx(steps / len(p), abs=1e-12)


def test_weighted_coverage_equals_copied_rows(spark, small, monkeypatch):
    monkeypatch.setattr(R, "SCAN_LINES", 4)
    rows, df = ranked_rows(spark)
    w = all_weights(spark, range(60), 30, 9)
    got = {(r["endpoint"], r["replicate"]): r["aurc"] for r in R.replicate_statistics(df, "y", "s", 30, 9, coverage=True, order=["unit_id", "side"]).collect()}
    assert len(got) == 60
    for (e, b), v in got.items():
        errors = np.array([y for _, _, _, y in sorted((s, u, side, y) for s, y, u, side in copied(rows, w, b, e))])
        assert v == pytest.approx(np.mean(np.cumsum(errors) / np.arange(1, len(errors) + 1)), abs=1e-12)


def test_replicates_without_a_class_are_dropped_and_counted(spark, small):
    df = spark.createDataFrame([("e", i, 1, int(i == 0), float(i)) for i in range(6)], "endpoint string, unit_id long, side int, y int, s double")
    replicates = R.replicate_statistics(df, "y", "s", 200, 9)
    w = all_weights(spark, range(6), 200, 9)
    good = int(((w[0] > 0) & (w[0] < 6)).sum())
    rows = R.percentile_intervals(replicates, R.RANKING).collect()
    assert [r["valid_replicates"] for r in rows] == [good, good] and good < 200
    assert R.replicate_statistics(df.filter("false"), "y", "s", 20, 9).count() == 0


def test_ranking_without_keys(spark, small):
    rows, df = ranked_rows(spark)
    fine = df.filter("endpoint = 'fine'")
    keyed = {r["replicate"]: r["auroc"] for r in R.replicate_statistics(fine, "y", "s", 25, 9).collect()}
    plain = {r["replicate"]: r["auroc"] for r in R.replicate_statistics(fine.drop("endpoint"), "y", "s", 25, 9, keys=()).collect()}
    assert plain.keys() == keyed.keys() and all(plain[b] == pytest.approx(v, abs=1e-12) for b, v in keyed.items())


def test_groups_of_slices_do_not_change_the_statistics(spark, small, monkeypatch):
    _, df = ranked_rows(spark)
    want = {(r["endpoint"], r["replicate"]): r for r in R.replicate_statistics(df, "y", "s", 45, 9).collect()}
    monkeypatch.setattr(R, "STORED_WEIGHTS", 1)  # a slice at a time lies on disk
    got = {(r["endpoint"], r["replicate"]): r for r in R.replicate_statistics(df, "y", "s", 45, 9).collect()}
    assert got.keys() == want.keys() and len(got) == 90
    assert all(got[k]["auroc"] == pytest.approx(r["auroc"], abs=1e-12) and got[k]["average_precision"] == pytest.approx(r["average_precision"], abs=1e-12) for k, r in want.items())
