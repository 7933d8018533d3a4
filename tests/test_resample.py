import hashlib

import numpy as np
import pytest

from dyadlab.operators import resample as B
from dyadlab.operators import risk as K


def draw(seed, replicate, n):
    out = []
    for block in range((n - 1) // 4 + 1):
        h = hashlib.sha256(f"{seed}|{replicate}|{block}".encode()).hexdigest()
        out += [int(h[15 * m:15 * m + 15], 16) % n for m in range(4) if 4 * block + m < n]
    return out


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([("e", i, float(i)) for i in range(1, 11)], "endpoint string, unit_id int, v double")


def test_means_follow_the_documented_draws(values):
    got = {r["replicate"]: r["mean"] for r in B.bootstrap_means(values, "v", 20, [7]).collect()}
    x = np.arange(1, 11, dtype=float)
    for b in range(20):
        assert got[b] == pytest.approx(x[draw(7, b, 10)].mean(), abs=1e-12)


def test_join_path_equals_broadcast_path(values, monkeypatch):
    first = sorted(tuple(r) for r in B.bootstrap_means(values, "v", 20, [7, 8]).collect())
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in B.bootstrap_means(values, "v", 20, [7, 8]).collect()) == first


def test_chunks_do_not_change_the_draws(values, monkeypatch):
    first = sorted(tuple(r) for r in B.bootstrap_means(values, "v", 5, [7]).collect())
    monkeypatch.setattr(B, "CHUNK", 1)
    assert sorted(tuple(r) for r in B.bootstrap_means(values, "v", 5, [7]).collect()) == first


def test_bca_against_numpy(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(1)
    x = rng.exponential(size=60)
    df = spark.createDataFrame([("e", i, float(v)) for i, v in enumerate(x)], "endpoint string, unit_id int, v double")
    got = B.bca_interval(df, "v", 400, [20261001]).first()
    means = np.array([x[draw(20261001, b, 60)].mean() for b in range(400)])
    nd = NormalDist()
    z0 = nd.inv_cdf(((means < x.mean()).sum() + 0.5 * (means == x.mean()).sum()) / 400)
    jack = (x.sum() - x) / 59
    d = jack.mean() - jack
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    limit = lambda q: np.quantile(means, nd.cdf(z0 + (z0 + nd.inv_cdf(q)) / (1 - a * (z0 + nd.inv_cdf(q)))))
    assert got["method"] == "BCa" and got["significance_eligible"]
    np.testing.assert_allclose([got["acceleration"], got["z0"], got["lower"], got["upper"]], [a, z0, limit(0.025), limit(0.975)], atol=1e-10)
    assert got["lower"] < got["estimate"] < got["upper"]


def test_degenerate_inputs(spark):
    df = spark.createDataFrame([("one", 1, 2.0), ("flat", 1, 3.0), ("flat", 2, 3.0)], "endpoint string, unit_id int, v double")
    got = {r["endpoint"]: r for r in B.bca_interval(df, "v", 50, [1]).collect()}
    assert got["one"]["method"] == "not_estimable" and got["one"]["lower"] is None and got["one"]["estimate"] == 2.0
    assert got["flat"]["lower"] == got["flat"]["upper"] == 3.0 and not got["flat"]["significance_eligible"]


def test_cluster_bootstrap_of_a_mean_keeps_units_together(spark):
    rows = spark.createDataFrame([("e", i // 2, i % 2 + 1, float(i // 2)) for i in range(40)], "endpoint string, unit_id int, side int, v double")
    from pyspark.sql import functions as F

    statistic = lambda df, keys: df.groupBy(*keys).agg(F.avg("v").alias("m"))
    got = B.cluster_bootstrap(rows, statistic, "m", 40, 3).first()
    means = [np.mean(draw(3, b, 20)) for b in range(40)]
    assert got["estimate"] == pytest.approx(9.5) and got["valid_replicates"] == 40 and got["units"] == 20
    np.testing.assert_allclose([got["lower"], got["upper"]], np.quantile(means, [0.025, 0.975]), atol=1e-12)


def test_reproduction_check(spark):
    a = spark.createDataFrame([("e", 1.0)], "endpoint string, r double")
    b = spark.createDataFrame([("e", 1.0 + 1e-9)], "endpoint string, r double")
    assert B.reproduction_check(a, a, ["endpoint"], ["r"]).first()["reproduced"]
    assert not B.reproduction_check(a, b, ["endpoint"], ["r"]).first()["reproduced"]
    assert K is not None


def test_draws_are_never_broadcast(spark, monkeypatch):
    """Above the old limit of a lookup by broadcast, Spark took the exploded draws for a small table and sent them to the driver."""
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    values = spark.createDataFrame([("e", i, float(i)) for i in range(3000)], "endpoint string, unit_id int, v double")
    found = B.bootstrap_means(values, "v", 50, [7])
    assert found.count() == 50
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = []
            for other in plan[i + 1:]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            assert not any("Generate" in other for other in below)


def test_ranges_and_slices_do_not_change_the_means(spark, monkeypatch):
    import math

    for name, size in (("RANGE", 4), ("SLICE", 3), ("CHUNK", 2)):
        monkeypatch.setattr(B, name, size)
    x = {"a": [0.5 * i * i for i in range(21)], "b": [float(i) for i in range(21)], "c": [1.0, 2.5, 4.0], "d": [None, 2.0, 3.0], "f": [math.inf, 1.0, 2.0]}
    lines = [(k, i, v) for k, vs in x.items() for i, v in enumerate(vs)]
    got = {(r["endpoint"], r["seed"], r["replicate"]): r["mean"] for r in B.bootstrap_means(spark.createDataFrame(lines, "endpoint string, unit_id int, v double"), "v", 10, [7, 8]).collect()}
    assert len(got) == 5 * 2 * 10
    for (k, seed, b), mean in got.items():
        taken = [x[k][i] for i in draw(seed, b, len(x[k])) if x[k][i] is not None]
        assert mean is None if not taken else mean == pytest.approx(sum(taken) / len(taken), abs=1e-12)


def test_weighted_cluster_bootstrap_equals_copies(spark, monkeypatch):
    from pyspark.sql import functions as F
    from dyadlab.operators import ranking as R

    monkeypatch.setattr(B, "RANGE", 8)
    monkeypatch.setattr(B, "SLICE", 5)
    rows = spark.createDataFrame([("e", str(i // 2), i % 2 + 1, i * 7 % 5 % 2, (i * 13 % 17) / 17) for i in range(60)], "endpoint string, unit_id string, side int, label int, prob double")
    copied = B.cluster_bootstrap(rows, lambda df, keys: R.binary_ranking(df, F.col("label"), "prob", keys), "auroc", 12, 3).first()
    weighted = B.cluster_bootstrap(rows, lambda df, keys: R.binary_ranking(df, F.col("label"), "prob", keys, "w"), "auroc", 12, 3, weight="w").first()
    assert weighted == copied and weighted["valid_replicates"] == 12 and weighted["units"] == 30
