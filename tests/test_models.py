import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadlab.operators import blocks as X
from dyadlab.operators import calibrate as Q
from dyadlab.operators import heads as H
from dyadlab.operators import lossmodel as L
from dyadlab.operators import nested as T
from dyadlab.operators import robust as G

PLAN = T.Plan(endpoints=("first", "second"), second_device="B", folds=5, inner=3, strengths=(0.1, 1.0))


def expit(z):
    return 1 / (1 + np.exp(-z))


def nll(y, p, eps=1e-6):
    q = np.clip(p, eps, 1 - eps)
    return -(y * np.log(q) + (1 - y) * np.log1p(-q))


# -- spline ------------------------------------------------------------------------------------------------------


def test_spline_is_a_partition_of_unity_with_linear_tails():
    knots = np.array([-2.0, -0.7, 0.1, 0.9, 3.0])
    z = np.linspace(-4, 5, 60)
    basis = L.spline_basis(z, knots)
    assert basis.shape == (60, L.BASIS)
    inside = (z >= knots[0]) & (z <= knots[-1])
    last = 1 - basis.sum(1)  # the dropped column
    assert (basis[inside] >= -1e-12).all() and (last[inside] >= -1e-12).all()
    tail = L.spline_basis(np.array([3.0, 4.0, 5.0]), knots)
    np.testing.assert_allclose(tail[2] - tail[1], tail[1] - tail[0], atol=1e-12)
    step = 1e-6  # value and slope are continuous at the end knot
    near = L.spline_basis(np.array([3.0 - step, 3.0, 3.0 + step]), knots)
    np.testing.assert_allclose(near[1] - near[0], near[2] - near[1], atol=1e-9)


def test_uniform_spline_values():
    at_knot = L.spline_basis(np.array([0.0]), np.arange(-2.0, 3.0))[0]  # cubic B-spline at a knot: 1/6, 4/6, 1/6
    np.testing.assert_allclose(at_knot, [0, 0, 1 / 6, 4 / 6, 1 / 6, 0], atol=1e-12)


def test_repeated_knots_stay_finite():
    basis = L.spline_basis(np.linspace(-1, 2, 9), np.array([0.0, 0.0, 0.0, 0.5, 1.0]))
    assert np.isfinite(basis).all()


# -- heads and calibrators -----------------------------------------------------------------------------------------


def newton_head(x, y, c):
    mean, sd = x.mean(0), x.std(0)
    a = np.column_stack([(x - mean) / np.where(sd > 0, sd, 1), np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.append(np.ones(x.shape[1]), 0) / c
    for _ in range(50):
        p = expit(a @ w)
        w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
    return w


@pytest.fixture(scope="module")
def pairs_frame():
    rng = np.random.default_rng(11)
    states = [(0, 0), (1, 1), (1, 0), (0, 1)] * 15
    lines = []
    for i, (r, l) in enumerate(states):
        x_r, x_l = rng.normal(size=6), rng.normal(size=6)
        x_r[0] += 0.9 * r
        x_l[0] += 0.9 * l
        lines.append((i, [float(v) for v in x_r], [float(v) for v in x_l], [r, int(x_r[1] + rng.normal() > 0)], [l, int(x_l[1] + rng.normal() > 0)],
                      2 if i % 5 == 0 else 1, 1, 2 if i % 7 == 0 else 1, 0 if i % 11 == 0 else 1, "A" if i % 2 else "B", "A" if i % 2 else "B"))
    return pd.DataFrame(lines, columns=["unit_id", "x_r", "x_l", "y_r", "y_l", "q1_r", "q1_l", "q2_r", "q2_l", "device_r", "device_l"])


@pytest.fixture(scope="module")
def pairs(spark, pairs_frame):
    schema = "unit_id bigint, x_r array<double>, x_l array<double>, y_r array<int>, y_l array<int>, q1_r int, q1_l int, q2_r int, q2_l int, device_r string, device_l string"
    return spark.createDataFrame([tuple(r) for r in pairs_frame.itertuples(index=False)], schema).repartition(3)


def test_heads_match_newton(spark, pairs, pairs_frame):
    whole = pairs.withColumns({"outer_fold": F.lit(0), "inner": F.array(F.lit(0))})
    heads = H.fit_heads(whole, [H.TrainingSet()], 2, (0.1, 1.0), tolerance=1e-9)
    x = np.stack([*pairs_frame["x_r"], *pairs_frame["x_l"]])
    for e in range(2):
        y = np.array([v[e] for v in [*pairs_frame["y_r"], *pairs_frame["y_l"]]])
        for c in (0.1, 1.0):
            want = newton_head(x, y, c)
            head = heads[(e, 0, c)]
            assert head.converged
            np.testing.assert_allclose([*head.weight, head.intercept], want, atol=1e-6)


def test_calibrators_on_the_monotone_fixture(spark):
    z = np.linspace(-3, 3, 60)
    y = (z + np.sin(z) > 0).astype(int)
    y[[20, 41]] = 1 - y[[20, 41]]  # keep the optimum inside the bounds
    rows = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(z, y)], "endpoint string, raw double, y int")
    got = {r["method"]: r for r in Q.fit_calibrators(rows, ["endpoint"]).collect()}
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4001))
    best = min(grid, key=lambda s: nll(y, expit(s * z)).mean())
    assert got["temperature"]["slope"] == pytest.approx(best, rel=2e-3) and got["temperature"]["intercept"] == 0
    a = np.column_stack([z, np.ones(60)])
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = expit(a @ w)
        w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a, a.T @ (p - y))
    np.testing.assert_allclose([got["platt"]["slope"], got["platt"]["intercept"]], w, atol=1e-6)
    assert all(r["slope"] > 0 for r in got.values())


def test_separable_scores_stop_at_the_bound(spark):
    rows = spark.createDataFrame([("k", float(v), int(v > 0)) for v in np.linspace(-3, 3, 40)], "endpoint string, raw double, y int")
    got = {r["method"]: r for r in Q.fit_calibrators(rows, ["endpoint"]).collect()}
    assert 0.05 <= got["platt"]["slope"] <= 20.0 and got["temperature"]["slope"] > 5


def test_crossfit_leaves_no_row_out_and_uses_other_folds_only(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=90)
    y = (rng.random(90) < expit(2 * z)).astype(int)
    rows = spark.createDataFrame([("k", i, float(a), int(b), i % 3) for i, (a, b) in enumerate(zip(z, y))], "endpoint string, id int, raw double, y int, fold int")
    lines, table = Q.crossfit_calibrate(rows, ["endpoint"], "fold", 3, ["platt"])
    assert lines.count() == 90 and table.count() == 4
    only = Q.fit_calibrators(rows.filter("fold <> 1").drop("fold"), ["endpoint"], ["platt"]).first()
    cross = table.filter("left_out = 1").first()
    assert cross["slope"] == pytest.approx(only["slope"], abs=1e-8)


def test_calibration_slope_of_a_perfect_model(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < expit(z)).astype(int)
    rows = spark.createDataFrame([("e", float(expit(a)), int(b)) for a, b in zip(z, y)], "endpoint string, prob double, label int")
    got = Q.calibration_slope(rows).first()
    assert abs(got["slope"] - 1) < 0.12 and abs(got["intercept"]) < 0.12
    perfect = spark.createDataFrame([("e", 0.2, 0), ("e", 0.8, 1)] * 5, "endpoint string, prob double, label int")
    assert Q.calibration_slope(perfect).first()["slope"] is None or Q.calibration_slope(perfect).first()["slope"] > 5


# -- ridge ---------------------------------------------------------------------------------------------------------


def direct_ridge(design, y, columns, alpha):
    at = [L.DESIGN.index(c) for c in columns]
    x = design[:, at].copy()
    for j, c in enumerate(columns):
        if "spline" in c:
            x[:, j] = (x[:, j] - x[:, j].mean()) / x[:, j].std()
    xc, yc = x - x.mean(0), y - y.mean()
    top = np.vstack([xc, np.sqrt(alpha) * np.eye(len(columns))])
    w = np.linalg.lstsq(top, np.concatenate([yc, np.zeros(len(columns))]), rcond=None)[0]
    return xc @ w + y.mean()


@pytest.mark.parametrize("alpha", [0.0, 0.1, 10.0])
def test_ridge_from_cross_products(alpha):
    rng = np.random.default_rng(6)
    own, partner = rng.normal(size=200), rng.normal(size=200)
    flags = rng.integers(0, 2, (200, 5)).astype(float)
    y = np.abs(own - partner) + rng.normal(scale=0.1, size=200)
    design = L.side_design(own, partner, flags, np.quantile(own, np.linspace(0, 1, 5)))
    products = L.cross_products(design, np.column_stack([y, y / 10]))
    for augmented in (False, True):
        model = L.solve(products, L.design_columns(augmented), "nll", alpha)
        want = np.clip(direct_ridge(design, y, L.design_columns(augmented), alpha), 0, L.NLL_LIMIT)
        np.testing.assert_allclose(model.predict(design), want, atol=1e-7)


def test_constant_column_with_alpha_zero_is_harmless():
    rng = np.random.default_rng(7)
    z = rng.normal(size=80)
    flags = np.zeros((80, 5))
    flags[:, 3] = rng.integers(0, 2, 80)
    design = L.side_design(z, z[::-1], flags, np.quantile(z, np.linspace(0, 1, 5)))
    model = L.solve(L.cross_products(design, np.column_stack([z**2, z**2])), L.design_columns(True), "nll", 0.0)
    assert np.isfinite(model.beta).all() and np.mean((model.predict(design) - z**2) ** 2) < 0.5


# -- nested stack --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def nested(spark, pairs):
    folded = T.with_folds(pairs, PLAN)
    return folded, T.run_nested(folded, PLAN)


def test_nested_coverage_and_contract(spark, nested):
    from dyadlab.operators.gates import validation_checks

    folded, result = nested
    got = result.predictions.toPandas()
    assert len(got) == 60 * 2 * 2 and not got.duplicated(["unit_id", "side", "endpoint"]).any()
    assert got["outer_fold"].nunique() == 5 and got["prob"].between(0, 1).all()
    assert got[["predicted_nll_r0", "predicted_nll_r1"]].min().min() >= 0 and got[["predicted_brier_r0", "predicted_brier_r1"]].max().max() <= 1
    np.testing.assert_allclose(got["nll"], nll(got["label"], got["prob"]), atol=1e-12)
    none = folded.select("unit_id").limit(0)
    checks = validation_checks(result.predictions, folded.select("unit_id", "outer_fold"), none, PLAN.methods, PLAN.strengths)
    assert checks.count() == 10 and checks.filter("NOT passed").isEmpty()
    leak = validation_checks(result.predictions, folded.select("unit_id", "outer_fold"), folded.select("unit_id").limit(1), PLAN.methods, PLAN.strengths)
    assert {r["check"] for r in leak.filter("NOT passed").collect()} == {"holdout_exclusion"}


def test_nested_scores_come_from_heads_that_never_saw_the_unit(nested, pairs_frame):
    folded, result = nested
    folds = folded.select("unit_id", "outer_fold", "inner").toPandas().set_index("unit_id")
    scores = result.scores.filter("endpoint = 'first' AND strength = 1.0").toPandas()
    frame = pairs_frame.set_index("unit_id")
    for assessed, left in ((0, None), (3, 2)):
        inner = np.array([v[assessed] for v in folds["inner"]])
        train = folds["outer_fold"] != assessed
        if left is not None:
            train &= inner != left
        part = frame.loc[folds.index[train]]
        w = newton_head(np.stack([*part["x_r"], *part["x_l"]]), np.array([v[0] for v in [*part["y_r"], *part["y_l"]]]), 1.0)
        x = np.stack([*part["x_r"], *part["x_l"]])
        lines = scores[(scores["assessed"] == assessed) & (scores["fold"] == (-1 if left is None else left))]
        assert not set(lines["unit_id"]) & set(part.index)
        z = (np.stack(frame.loc[lines["unit_id"], "x_r"]) - x.mean(0)) / x.std(0)
        np.testing.assert_allclose(lines["raw_r"], z @ w[:-1] + w[-1], atol=1e-4)


def test_nested_selection_and_final_loss_model_against_numpy(nested, pairs_frame):
    folded, result = nested
    endpoint, assessed = "second", 1
    scores = result.scores.filter(f"endpoint = '{endpoint}' AND assessed = {assessed}").toPandas()
    table = result.calibrators.filter(f"endpoint = '{endpoint}' AND assessed = {assessed}").toPandas()
    selected = result.selected.filter(f"endpoint = '{endpoint}' AND assessed = {assessed}").first()
    at = table.set_index(["strength", "method", "left_out"])[["slope", "intercept"]]

    def prob(lines, key, s):
        a, b = at.loc[key]
        return expit(a * lines[f"raw_{s}"].to_numpy() + b)

    risks = {}
    for c in PLAN.strengths:
        for m in PLAN.methods:
            total = []
            for f in range(3):
                lines = scores[(scores["strength"] == c) & (scores["fold"] == f)]
                total += list((nll(lines["y_r"], prob(lines, (c, m, f), "r")) + nll(lines["y_l"], prob(lines, (c, m, f), "l"))) / 2)
            risks[(c, m)] = np.mean(total)
    best = min(risks, key=risks.get)
    assert (selected["strength"], selected["method"]) == best and selected["risk"] == pytest.approx(risks[best], abs=1e-9)

    frame = pairs_frame.set_index("unit_id")
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(p, 1e-6, 1 - 1e-6))
    parts = []
    for f in (0, 1, 2, -1):
        lines = scores[(scores["strength"] == best[0]) & (scores["fold"] == f)].copy()
        for s in "rl":
            lines[f"p_{s}"] = prob(lines, (*best, f), s)
        parts.append(lines)
    lines = pd.concat(parts)

    def flags(ids, s):
        part = frame.loc[ids]
        q2 = part[f"q2_{s}"]
        return np.column_stack([part[f"q1_{s}"] == 2, q2 == 2, ~q2.isin([1, 2]), np.full(len(part), s == "r"), part[f"device_{s}"] == "B"]).astype(float)

    def both(part):
        own = np.concatenate([logit(part["p_r"]), logit(part["p_l"])])
        partner = np.concatenate([logit(part["p_l"]), logit(part["p_r"])])
        y = np.concatenate([nll(part["y_r"], part["p_r"]), nll(part["y_l"], part["p_l"])])
        return own, partner, np.vstack([flags(part["unit_id"], "r"), flags(part["unit_id"], "l")]), y

    train, assess = lines[lines["fold"] >= 0], lines[lines["fold"] == -1].sort_values("unit_id")
    own, partner, fl, y = both(train)
    knots = np.quantile(own, np.linspace(0, 1, 5))
    chosen = result.alphas.filter(f"endpoint = '{endpoint}' AND assessed = {assessed} AND target = 'nll' AND model = 'r1' AND chosen").first()["alpha"]
    design = L.side_design(own, partner, fl, knots)
    model = L.solve(L.cross_products(design, np.column_stack([y, y])), L.design_columns(True), "nll", chosen)
    o, p, f2, _ = both(assess)
    want = model.predict(L.side_design(o, p, f2, knots))
    got = result.predictions.filter(f"endpoint = '{endpoint}' AND outer_fold = {assessed}").toPandas().sort_values(["side", "unit_id"])
    np.testing.assert_allclose(got["predicted_nll_r1"], want, atol=1e-6)


def test_final_stack_round_trip(spark, nested, tmp_path):
    from dyadlab.sources.sinks import AlreadyWritten, write_tables

    folded, result = nested
    choices = T.final_choices(result, PLAN)
    assert choices.count() == 12
    stack = T.fit_final(result, PLAN)
    contract = T.schema_contract(stack.losses).collect()
    assert len(contract) == 4 and all(r["passed"] and len(r["added"]) == L.BASIS for r in contract)
    write_tables(stack.tables(), str(tmp_path / "stack"))
    with pytest.raises(AlreadyWritten):
        write_tables(stack.tables(), str(tmp_path / "stack"))
    stored = T.FrozenStack(*[spark.read.parquet(str(tmp_path / "stack" / n)) for n in ("heads", "calibrators", "losses")])
    scored = T.score_frozen(folded, stored, PLAN).toPandas().sort_values(["endpoint", "unit_id", "side"])
    again = T.score_frozen(folded, stack, PLAN).toPandas().sort_values(["endpoint", "unit_id", "side"])
    assert len(scored) == 240 and (scored["outer_fold"] == -1).all()
    np.testing.assert_allclose(scored["predicted_nll_r1"], again["predicted_nll_r1"], atol=1e-12)
    from pyspark.sql.types import StructField  # noqa: F401

    plan = T.score_frozen(folded, stored, PLAN)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # projections only


# -- robust regressions --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def analysis(spark):
    rng = np.random.default_rng(12)
    lines = []
    for i in range(240):
        r, l = [(0, 0), (1, 1), (1, 0), (0, 1)][i % 4]
        z = rng.normal(size=2) + np.array([r, l])
        q1, q2 = rng.integers(1, 3, 2), rng.choice([0, 1, 2], 2, p=[0.05, 0.7, 0.25])
        d = [str(v) for v in rng.choice(["A", "B"], 2, p=[0.6, 0.4])]
        for s in range(2):
            y = (r, l)[s]
            p = expit(z[s])
            loss = float(nll(y, p))
            lines.append(("e", i, s + 1, y, (r, l)[1 - s], float(z[s]), float(z[1 - s]), int(q1[s]), int(q2[s]), d[s], d[1 - s], loss, float(loss + rng.normal() * 0.3), float(loss + rng.normal() * 0.2)))
    columns = ["endpoint", "unit_id", "side", "label", "partner_label", "z", "partner_z", "q1", "q2", "device", "partner_device", "nll", "predicted_nll_r0", "predicted_nll_r1"]
    frame = pd.DataFrame(lines, columns=columns)
    return frame, spark.createDataFrame(frame).repartition(3)


def test_clustered_model_against_explicit_clusters(analysis):
    frame, rows = analysis
    table, omnibus = G.gee_exchangeable(G.contrast_units(rows, "B"))
    got = {r["term"]: r for r in table.collect()}
    state = np.where(frame["side"] == 1, frame["label"].astype(str) + frame["partner_label"].astype(str), frame["partner_label"].astype(str) + frame["label"].astype(str))
    x = np.column_stack([np.ones(len(frame)), *[state == s for s in ("11", "10", "01")], frame["q1"] == 2, frame["q2"] == 2, ~frame["q2"].isin([1, 2]), frame["side"] == 1, frame["device"] == "B", frame["device"] != frame["partner_device"]]).astype(float)
    y = ((frame["nll"] - frame["predicted_nll_r0"]) ** 2 - (frame["nll"] - frame["predicted_nll_r1"]) ** 2).to_numpy()
    n, p = len(frame), x.shape[1]
    groups = [np.flatnonzero(frame["unit_id"] == u) for u in frame["unit_id"].unique()]
    alpha = 0.0
    for _ in range(200):
        v = np.linalg.inv(np.array([[1, alpha], [alpha, 1]]))
        a = sum(x[g].T @ v @ x[g] for g in groups)
        beta = np.linalg.solve(a, sum(x[g].T @ v @ y[g] for g in groups))
        e = y - x @ beta
        alpha = sum(e[g][0] * e[g][1] for g in groups) / (e @ e / (n - p)) / (len(groups) - p)
    u = np.stack([x[g].T @ v @ e[g] for g in groups])
    cov = np.linalg.inv(a) @ u.T @ u @ np.linalg.inv(a)
    for i, name in enumerate(G.GEE_TERMS):
        assert got[name]["estimate"] == pytest.approx(beta[i], abs=1e-8)
        assert got[name]["robust_standard_error"] == pytest.approx(np.sqrt(cov[i, i]), abs=1e-8)
    wald = beta[1:4] @ np.linalg.inv(cov[1:4, 1:4]) @ beta[1:4]
    assert omnibus.first()["statistic"] == pytest.approx(wald, rel=1e-6)


def test_asymmetry_model_against_direct_least_squares(spark, analysis):
    frame, _ = analysis
    r, l = (frame[frame["side"] == s].set_index("unit_id") for s in (1, 2))
    pairs = pd.DataFrame({"unit_id": r.index, "endpoint": "e", "state": r["label"].astype(str) + l["label"].astype(str), "label_r": r["label"], "label_l": l["label"], "z_r": r["z"], "z_l": l["z"], "q1_r": r["q1"], "q1_l": l["q1"],
                          "q2_r": r["q2"], "q2_l": l["q2"], "device_pair": np.where(r["device"] != l["device"], "mixed", r["device"] + "/" + r["device"])})
    got = {x["term"]: x for x in G.asymmetry_model(spark.createDataFrame(pairs), "B/B").collect()}
    ok = pairs[pairs["q2_r"].isin([1, 2]) & pairs["q2_l"].isin([1, 2])]
    evidence = ((ok["z_r"] + ok["z_l"]) / 2).to_numpy()
    s = np.column_stack([ok["state"] == k for k in ("11", "10", "01")]).astype(float)
    f = {c: (ok[c] == 2).to_numpy(dtype=float) for c in ("q1_r", "q1_l", "q2_r", "q2_l")}
    q = np.column_stack([(f["q1_r"] + f["q1_l"]) / 2, f["q1_r"] - f["q1_l"], (f["q2_r"] + f["q2_l"]) / 2, f["q2_r"] - f["q2_l"], ok["device_pair"] == "B/B", ok["device_pair"] == "mixed"]).astype(float)
    cross = [s[:, i] * q[:, j] for i in range(3) for j in (1, 3, 4)]
    x = np.column_stack([np.ones(len(ok)), L.spline_basis(evidence, np.quantile(evidence, np.linspace(0, 1, 5))), s, q, *cross])
    y = (ok["z_r"] - ok["z_l"]).to_numpy()
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    w = ((y - x @ beta) / (1 - h)) ** 2
    se = np.sqrt(np.diag(inverse @ (x.T * w) @ x @ inverse))
    assert got["const"]["units"] == len(ok)
    for i, name in enumerate(G.OLS_TERMS):
        assert got[name]["estimate"] == pytest.approx(beta[i], abs=1e-6)
        assert got[name]["standard_error"] == pytest.approx(se[i], rel=1e-5)


def test_chi_square_tail():
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729)):
        assert G.chi2_tail(x, df) == pytest.approx(0.05, abs=1e-6)


def test_holm_family_and_estimable_terms(analysis):
    from dyadlab.operators.ranking import holm

    _, rows = analysis
    units = G.contrast_units(rows, "B")
    family = holm(G.holm_family(*G.gee_exchangeable(units))).collect()
    assert len(family) == 3 and all(r["adjusted_p"] >= r["p_value"] - 1e-12 for r in family)
    none = rows.withColumn("q2", F.when(F.col("q2") == 0, 1).otherwise(F.col("q2")))
    flags = {r["term"]: r["estimable"] for r in G.estimable_terms(G.contrast_units(none, "B")).collect()}
    assert not flags["q2_unevaluable"] and flags["q1_abnormal"]


def test_blocks_telescope(spark, analysis):
    frame, _ = analysis
    r, l = (frame[frame["side"] == s].set_index("unit_id") for s in (1, 2))
    wide = pd.DataFrame({"endpoint": "e", "unit_id": r.index, "fold": r.index % 4, **{f"{c}_{s}": d[c] for c in ("z", "nll", "q1", "q2", "device") for s, d in (("r", r), ("l", l))}})
    wide["brier_r"], wide["brier_l"] = wide["nll_r"] / 10, wide["nll_l"] / 10
    got = X.block_contributions(L.indicator_arrays(spark.createDataFrame(wide), "B"), 4).toPandas()
    for name, part in got.groupby("sequence"):
        part = part.sort_values("position")
        assert len(part) == 4
        np.testing.assert_allclose(part["risk_after"].to_numpy()[:-1], part["risk_before"].to_numpy()[1:], atol=1e-12)
    ends = got.groupby("sequence")["removed"].sum()
    assert ends["forward"] == pytest.approx(ends["reverse"], abs=1e-10)
