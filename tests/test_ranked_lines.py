"""What travels between the draws and the scan of a ranking, and draws of the older bootstrap carried along an order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlab.operators import ranked_bootstrap as RB
from dyadlab.operators import ranking as R
from dyadlab.operators import resample as B
from dyadlab.operators import tree_bootstrap as T


def shuffled_lines(spark, job) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (lambda s: [s.apply(i) for i in range(s.size())])(
        store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    job()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("coverage", [False, True])
def test_no_line_of_a_row_and_slice_is_shuffled(spark, coverage):
    """a row had one line for every 500 replicates, which Spark sorted and Python read one by one."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([("e", i // 2, i % 2, int(r.random() < 0.3), float(r.random())) for i in range(3000)], "endpoint string, unit_id long, side int, y int, s double")
    count = shuffled_lines(spark, lambda: RB.replicate_statistics(df, "y", "s", 5000, 3, coverage=coverage, order=["unit_id", "side"] if coverage else ()).count())
    assert count < 3000 * 10  # as many as rows x slices before, besides what the order and the blocks take


def test_packed_weights_come_back():
    r = np.random.default_rng(1)
    for top in (2, 16, 300, 70_000):
        weights = r.integers(0, top, (7, RB.LANES))
        width, data = RB._packed(weights)
        assert width == (0 if top <= 16 else np.min_scalar_type(int(weights.max())).itemsize)
        np.testing.assert_array_equal(RB._unpacked(width, data.tobytes()), weights)
    lines = r.integers(0, 9, (500, RB.LANES)).astype(np.uint8)
    begin = np.array([0, 1, 2, 130, 450])
    np.testing.assert_array_equal(RB._folded(lines, begin), np.add.reduceat(lines.astype(int), begin, axis=0))


def test_weights_by_unit_are_the_weights():
    draws = T.Draws(T.Tree({"": {i << 10: 700 for i in range(3)}}))
    for block in range(2):
        np.testing.assert_array_equal(draws.by_unit(5, "", block, 1400, 2), draws.weights(5, "", block, 1400, 2).T)


def test_coverage_of_many_repeated_rows():
    """Sums of errors / rows by harmonic numbers, beyond the tabled ones and over several ranges."""
    r = np.random.default_rng(6)
    weights, error = r.integers(0, 5, (900, RB.LANES)).astype(np.uint8), r.random(900) < 0.2
    scan = RB._Scan()
    for a in range(0, 900, 300):
        mixed = r.permutation(300)
        scan.cover(np.arange(a, a + 300.0)[mixed], error[a : a + 300][mixed], weights[a : a + 300][mixed])
    usable, (aurc,) = scan.covered()
    assert usable.all()
    for lane in range(RB.LANES):
        copies = np.repeat(error, weights[:, lane])
        assert aurc[lane] == pytest.approx(np.mean(np.cumsum(copies) / np.arange(1, len(copies) + 1)), abs=1e-13)


def test_digests_taken_together_are_sha256():
    import hashlib

    for prefix, first, last in ((b"20261001|17|", 9_000, 14_000), (b"-5|0|", 0, 5_000), (b"9223372036854775807|2147483647|", 10**18 - 2, 10**18 + 3_000)):
        want = b"".join(hashlib.sha256(prefix + b"%d" % i).digest() for i in range(first, last))
        np.testing.assert_array_equal(B._digests(prefix, first, last), np.frombuffer(want, ">u8").reshape(-1, 4))


@pytest.mark.parametrize("width,chunk", [(4, 2), (16, 1 << 20)])
def test_carried_draws_equal_copied_rows(spark, monkeypatch, width, chunk):
    """keys of equal and of other size, ties, two slices; the same draws as the cluster bootstrap that copies rows."""
    monkeypatch.setattr(B, "RANGE", width)
    monkeypatch.setattr(B, "CHUNK", chunk)
    monkeypatch.setattr(RB, "SCAN_LINES", 7)
    sizes = {"a": 30, "b": 30, "c": 17}
    rows = spark.createDataFrame([(k, i, side, (i * 7 + side) % 5 % 2, (i * 13 % 17) / 17 if k != "b" else (i * 31 + side) / 999) for k, n in sizes.items() for i in range(n) for side in (1, 2)],
                                 "endpoint string, unit_id int, side int, label int, prob double")
    want = {r["endpoint"]: r for r in B.cluster_bootstrap(rows, lambda df, keys: R.binary_ranking(df, F.col("label"), "prob", keys), "auroc", 503, 3).collect()}
    got = {r["endpoint"]: r for r in RB.cluster_intervals(rows, "label", "prob", "auroc", 503, 3).collect()}
    assert got.keys() == want.keys() == sizes.keys()
    for k, r in got.items():
        assert (r["units"], r["valid_replicates"], r["requested_replicates"]) == (sizes[k], want[k]["valid_replicates"], 503)
        assert r["lower"] == pytest.approx(want[k]["lower"], abs=1e-12) and r["upper"] == pytest.approx(want[k]["upper"], abs=1e-12)


def test_cluster_bootstrap_asks_for_all_replicates():
    """20 replicates stood in code and SQL; the protocol has 10,000."""
    from dyadlab.plans import resample_queries as Q
    from dyadlab.plans.catalog import SQL

    assert Q.CLUSTER_REPLICATES == 10_000 and "range(10000) t(r)" in SQL["cluster_bootstrap_auroc"]
