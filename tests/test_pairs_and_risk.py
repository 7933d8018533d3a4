import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import audit as A
from dyadlab.operators import cohort as C
from dyadlab.operators import pairs as P
from dyadlab.operators import ranking as R
from dyadlab.operators import risk as K
from dyadlab.plans.views import pair_predictions, predictions

DATA = "/root/testdata/sf{}"


def test_pair_wide_keeps_only_clean_units(spark):
    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 5), (3, 1, 1), (3, 1, 2), (4, 1, 1), (4, 2, 2), (4, 2, 3)], "unit_id int, side int, v int")
    assert [tuple(r) for r in P.pair_wide(rows, ["v"]).collect()] == [(1, 10, 20)]
    both = sorted(tuple(r) for r in P.with_partner(rows, ["v"]).collect())
    assert both == [(1, 1, 10, 20), (1, 2, 20, 10)]


def test_checked_join_rejects_repeated_keys(spark):
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(P.CardinalityError):
        P.checked_join(one, two, ["k"], "left", "many_to_one")
    assert P.checked_join(two, one, ["k"], "left", "many_to_one").count() == 2
    with pytest.raises(P.CardinalityError):
        P.checked_join(two, one, ["k"], "left", "one_to_one")


def test_attach_unit_raises_on_a_missing_unit(spark):
    rows, units = spark.createDataFrame([(1,), (2,)], "unit_id int"), spark.createDataFrame([(1, "s")], "unit_id int, state string")
    with pytest.raises(Exception, match="row without state"):
        P.attach_unit(rows, units, required="state").collect()


@pytest.mark.parametrize("scale, units, r0, r1, delta, positive", [
    ("0.001", 147, 0.23385865, 0.20799241, 0.02586625, 0.428571), ("0.01", 1585, 0.19389318, 0.17354989, 0.0203433, 0.399369), ("0.1", 15611, 0.19861336, 0.17754866, 0.0210647, 0.395042)])
def test_minimum_slice(spark, scale, units, r0, r1, delta, positive):
    line = K.risk_contrast(predictions(spark, DATA.format(scale))).filter("endpoint = 'discount'").first()
    assert line["units"] == units
    np.testing.assert_allclose([line["risk_r0"], line["risk_r1"], line["delta"]], [r0, r1, delta], atol=1e-8)
    assert abs(line["positive_fraction"] - positive) < 1e-6


def test_invariants_of_the_tables(spark):
    folder = DATA.format("0.001")
    rows, pairs = predictions(spark, folder), pair_predictions(spark, folder)
    overall = {r["endpoint"]: r["delta"] for r in K.risk_contrast(rows).collect()}
    for r in K.state_risk(rows).groupBy("endpoint").agg(F.sum("weighted_delta").alias("d")).collect():
        assert abs(r["d"] - overall[r["endpoint"]]) < 1e-12
    for r in K.loss_tail(K.unit_risks(rows)).groupBy("endpoint").agg(F.sum("net_share").alias("s"), F.count("*").alias("n")).collect():
        assert abs(r["s"] - 1) < 1e-9 and r["n"] == 5
    assert K.state_counts(pairs).count() == 12
    histogram = K.contribution_histogram(K.unit_risks(rows)).groupBy("endpoint").agg((F.sum("units") + F.first("below") + F.first("above")).alias("n"))
    assert {r["n"] for r in histogram.collect()} == {147}


def test_zero_filled_states(spark):
    pairs = spark.createDataFrame([("e", "00"), ("e", "11")], "endpoint string, state string")
    assert {r["state"]: r["units"] for r in K.state_counts(pairs).collect()} == {"00": 1, "11": 1, "10": 0, "01": 0}


def test_clip_limit(spark):
    row = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "y double, p double").select(S.binary_nll(F.col("y"), F.col("p")).alias("l")).collect()
    np.testing.assert_allclose([r["l"] for r in row], 13.815510557964274, atol=1e-9)


def test_null_quality_counts_as_unevaluable(spark):
    df = spark.createDataFrame([(None, None), (1, 2), (0, 1)], "q int, p int")
    got = [tuple(r) for r in df.select(S.unevaluable(F.col("q")), S.directional_stratum(F.col("q"), F.col("p"))).collect()]
    assert got == [(True, "unevaluable"), (False, "own_satisfactory__fellow_abnormal"), (True, "unevaluable")]


def test_ranking_metrics_against_direct_count(spark):
    rng = np.random.default_rng(5)
    score, label = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300)
    df = spark.createDataFrame([("e", float(s), int(y)) for s, y in zip(score, label)], "endpoint string, s double, y int")
    got = R.binary_ranking(df, F.col("y"), "s").first()
    p, q = score[label == 1], score[label == 0]
    auroc = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / len(p) / len(q)
    ap = sum((p == t).sum() / len(p) * (label[score >= t].mean()) for t in np.unique(score))
    np.testing.assert_allclose([got["auroc"], got["average_precision"]], [auroc, ap], atol=1e-12)
    one_class = R.binary_ranking(df.filter("y = 1"), F.col("y"), "s").first()
    assert one_class["auroc"] is None and one_class["average_precision"] is None


def test_hamilton_sums_and_ties(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 10), ("c", 5)], "k string, n bigint")
    quota = {r["k"]: r["quota"] for r in C.hamilton(counts, "k", F.lit(6)).collect()}
    assert sum(quota.values()) == 6 and quota == {"a": 3, "b": 2, "c": 1}


def test_hamilton_does_not_overflow(spark):
    counts = spark.createDataFrame([("a", 6_000_000_000), ("b", 4_000_000_000)], "k string, n bigint")
    assert {r["k"]: r["quota"] for r in C.hamilton(counts, "k", F.lit(2_500_000_000)).collect()} == {"a": 1_500_000_000, "b": 1_000_000_000}


def test_partition_and_folds(spark):
    rng = np.random.default_rng(2)
    units = spark.createDataFrame([(int(i), str(rng.choice(["00", "11", "10", "01"], p=[0.78, 0.12, 0.05, 0.05])), str(rng.choice(["A/A", "B/B"]))) for i in range(800)], "unit_id bigint, state string, device_pair string")
    placed = C.assign_holdout(units, "device_pair", "state", 0.25, 1)
    assert placed.filter("partition = 'final_holdout'").count() == 200 and placed.count() == 800
    manifest = C.fold_manifest(units, folds=5, inner=3).toPandas()
    assert len(manifest) == 4000 and manifest.groupby("unit_id")["outer_fold"].nunique().max() == 1
    own = manifest["outer_fold"] == manifest["assessed"]
    assert manifest.loc[own, "inner_fold"].isna().all() and manifest.loc[~own, "inner_fold"].notna().all()
    sizes = manifest[own].groupby("outer_fold").size()
    assert sizes.max() - sizes.min() <= 1
    assert C.fold_violations(C.outer_folds(units), "outer_fold", 5).isEmpty()
    again = C.fold_manifest(units.repartition(11), folds=5, inner=3).toPandas()
    order = ["unit_id", "assessed"]
    assert again.sort_values(order).reset_index(drop=True).equals(manifest.sort_values(order).reset_index(drop=True))


def test_unrelated_partner_never_returns_the_unit_itself(spark):
    units = spark.createDataFrame([(i, "00" if i < 30 else "11", float(i)) for i in range(40)], "unit_id int, state string, z double")
    got = C.unrelated_partner(units, "state", ["z"], 4)
    assert got.count() == 40 and got.filter("unit_id = control_unit OR (unit_id < 30) <> (control_unit < 30)").isEmpty()
    assert got.select("control_unit").distinct().count() == 40


def test_leakage_split_sizes(spark):
    rows = spark.createDataFrame([(i // 2, i) for i in range(200)], "unit_id int, row int")
    got = A.row_split_leakage(rows, ["row"], 3, 1).collect()
    assert len(got) == 3 and all(r["units"] == 100 and r["repeated_units"] == 100 and 0 < r["units_in_several"] < 100 for r in got)


def test_schema_drift(spark):
    found = {(r["code"], r["message"]) for r in A.schema_drift(spark, ["a", "b"], ["a", "c"], ["b"]).collect()}
    assert found == {("MISSING_COLUMN", "c"), ("UNEXPECTED_COLUMN", "b"), ("LEGACY_COLUMN", "b")}


def test_fixed_sequence_stops(spark):
    tests = spark.createDataFrame([(0, True), (1, False), (2, True)], "position int, supported boolean")
    got = [r["status"] for r in R.fixed_sequence(tests).orderBy("position").collect()]
    assert got == ["supported", "not_supported_sequence_stops", "descriptive_after_gate_failure"]
