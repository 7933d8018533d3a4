"""Nested cross-validated stack (head, calibrator, loss models), final refit, and scoring with frozen parameters.

Input: one wide line per unit with ``x_r, x_l`` (features), ``y_r, y_l`` (one 0/1 per endpoint), quality codes and
devices of both sides, ``outer_fold`` and ``inner`` (its inner fold for every outer fold, -1 for its own).
A unit's sides never separate, so unit means need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import calibrate as Q
from dyadlab.operators import heads as H
from dyadlab.operators import lossmodel as L
from dyadlab.operators.cohort import fold_manifest
from dyadlab.operators.pairs import UNIT
from dyadlab.operators.ranking import best_within_tolerance, modal_choice
from dyadlab.operators.sums import Columns, grouped_sums, map_columns
from dyadlab.session import cut

N = S.number
META = ["q1_r", "q1_l", "q2_r", "q2_l", "device_r", "device_l"]
SELECTION = [(t, m) for t in L.TARGETS for m in L.MODELS]
TIE = 1e-12


@dataclass(frozen=True)
class Plan:
    endpoints: tuple[str, ...]
    second_device: str
    folds: int = 5
    inner: int = 3
    strengths: tuple[float, ...] = H.STRENGTHS
    alphas: tuple[float, ...] = L.ALPHAS
    methods: tuple[str, ...] = Q.METHODS
    outer_seed: int = 20260901
    inner_seed: int = 20260902


def with_folds(pairs: DataFrame, plan: Plan) -> DataFrame:
    """Attach outer and inner folds; strata are the states of the first endpoint."""
    state = S.pair_state(F.col("y_r")[0], F.col("y_l")[0])
    manifest = fold_manifest(pairs.select(UNIT, state.alias("state")), "state", plan.folds, plan.inner, plan.outer_seed, plan.inner_seed)
    own = lambda o: F.coalesce(F.max(F.when(F.col("assessed") == o, F.col("inner_fold"))), F.lit(-1))
    packed = manifest.groupBy(UNIT).agg(F.max("outer_fold").alias("outer_fold"), F.array(*[own(o) for o in range(plan.folds)]).alias("inner"))
    return cut(pairs.join(packed, UNIT))


def _score_lines(scored: DataFrame, plan: Plan) -> DataFrame:
    """Array positions to lines: endpoint, assessed outer fold, strength, the unit's inner fold there (-1 = assessed)."""
    e, o, c = len(plan.endpoints), plan.folds, len(plan.strengths)
    j = F.col("j")
    endpoint = F.floor(j / (o * c)).cast("int")
    wide = scored.select("*", F.posexplode(F.arrays_zip("score_r", "score_l")).alias("j", "s"))
    return wide.select(
        UNIT, "outer_fold", *META,
        F.get(F.array(*map(F.lit, plan.endpoints)), endpoint).alias("endpoint"),
        (F.floor(j / c) % o).cast("int").alias("assessed"),
        F.get(F.array(*[N(x) for x in plan.strengths]), (j % c).cast("int")).alias("strength"),
        F.get("inner", (F.floor(j / c) % o).cast("int")).cast("int").alias("fold"),
        F.get("y_r", endpoint).cast("int").alias("y_r"), F.get("y_l", endpoint).cast("int").alias("y_l"),
        F.col("s.score_r").alias("raw_r"), F.col("s.score_l").alias("raw_l"))


def _sides(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lines.select(*keys, F.explode(F.array(
        F.struct(F.col("raw_r").alias("raw"), F.col("y_r").alias("y")), F.struct(F.col("raw_l").alias("raw"), F.col("y_l").alias("y")))).alias("_s")).select(*keys, "_s.*")


def _pair_calibrated(lines: DataFrame) -> DataFrame:
    """Probabilities, logits and losses of both sides from slope and intercept columns."""
    a, b = F.col("slope"), F.col("intercept")
    out = lines.withColumns({f"p_{s}": Q.calibrated(F.col(f"raw_{s}"), a, b) for s in "rl"})
    return out.withColumns({
        **{f"z_{s}": S.logit(F.col(f"p_{s}")) for s in "rl"},
        **{f"nll_{s}": S.binary_nll(F.col(f"y_{s}").cast("double"), F.col(f"p_{s}")) for s in "rl"},
        **{f"brier_{s}": S.brier(F.col(f"y_{s}").cast("double"), F.col(f"p_{s}")) for s in "rl"}})


def _loss_frame(lines: DataFrame, plan: Plan) -> DataFrame:
    return cut(L.indicator_arrays(_pair_calibrated(lines), plan.second_device))


def _fit_products(frame: DataFrame, knots: dict[int, np.ndarray], member) -> dict[int, np.ndarray]:
    """Cross-products per training set; ``member(columns, set)`` says which lines belong to it."""

    def compute(c: Columns) -> dict[int, np.ndarray]:
        own, partner, flags = L.side_values(c)
        targets = np.column_stack([np.concatenate([c[f"{t}_r"], c[f"{t}_l"]]) for t in L.TARGETS])
        out = {}
        for k, at in knots.items():
            keep = np.tile(member(c, k), 2)
            if keep.any():
                out[k] = L.cross_products(L.side_design(own[keep], partner[keep], flags[keep], at), targets[keep])
        return out

    return grouped_sums(frame.select("set_code", "fold", "z_r", "z_l", "flags_r", "flags_l", *[f"{t}_{s}" for t in L.TARGETS for s in "rl"]), compute)


@dataclass
class NestedResult:
    predictions: DataFrame  # one row per unit, side and endpoint, out of fold
    candidates: DataFrame  # endpoint, assessed, strength, method, risk
    selected: DataFrame
    alphas: DataFrame  # endpoint, assessed, target, model, alpha, risk, chosen
    calibrators: DataFrame
    heads: dict[H.Task, H.Head]
    sets: list[H.TrainingSet]
    scores: DataFrame


def run_nested(pairs: DataFrame, plan: Plan) -> NestedResult:
    """Out-of-fold predictions of the whole stack for every endpoint at once."""
    spark = pairs.sparkSession
    sets = H.nested_sets(plan.folds, plan.inner)
    heads = H.fit_heads(pairs, sets, len(plan.endpoints), plan.strengths)
    keep = [UNIT, *META, "outer_fold", "inner", "y_r", "y_l"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keep).schema)
    scores = cut(_score_lines(H.score_folds(pairs, heads, sets, len(plan.endpoints), plan.strengths, plan.folds, keep, schema), plan))

    # calibrators, cross-fitted over the inner folds; candidate risk is the unit mean of the calibrated loss
    keys = ["endpoint", "assessed", "strength"]
    training = scores.filter("fold >= 0")
    table = Q.fit_calibrators(Q.crossfit_training(_sides(training, [*keys, "fold"]), "fold", plan.inner), [*keys, "left_out"], plan.methods)
    own = F.broadcast(table.withColumnRenamed("left_out", "fold"))  # fits x methods lines
    tried = _pair_calibrated(training.join(own, [*keys, "fold"]))
    candidates = tried.groupBy(*keys, "method").agg(F.avg((F.col("nll_r") + F.col("nll_l")) / N(2)).alias("risk"))
    candidates = spark.createDataFrame(candidates.collect(), candidates.schema)  # endpoints x folds x strengths x methods lines
    rank = F.array_position(F.array(*map(F.lit, plan.methods)), F.col("method"))
    selected = best_within_tolerance(candidates, "risk", [F.col("strength"), rank], ["endpoint", "assessed"], TIE)
    selected = spark.createDataFrame(selected.collect(), selected.schema)  # endpoints x folds lines

    # calibrated pairs under the selected choice: cross-fitted for training lines, the full calibrator for assessed ones
    chosen = F.broadcast(selected.select(*keys, "method"))
    parameters = F.broadcast(table.join(chosen, [*keys, "method"]).withColumnRenamed("left_out", "fold").drop("converged"))
    code = F.array_position(F.array(*map(F.lit, plan.endpoints)), F.col("endpoint")) - 1
    frame = _loss_frame(
        scores.join(parameters, [*keys, "fold"]).withColumn("set_code", (code * plan.folds + F.col("assessed")).cast("int")), plan)

    # loss models: knots and cross-products per training set (-1: all inner folds), then every alpha from one matrix
    width = plan.inner + 1

    def subsets(c: Columns) -> dict[int, np.ndarray]:
        return {s * width + left + 1: (c["set_code"] == s) & (c["fold"] >= 0) & (c["fold"] != left) for s in np.unique(c["set_code"]).tolist() for left in range(-1, plan.inner)}

    knots = L.subset_knots(frame, ["set_code", "fold"], subsets)

    def member(c: Columns, k: int) -> np.ndarray:
        left = k % width - 1
        return (c["set_code"] == k // width) & (c["fold"] >= 0) & (c["fold"] != left)

    products = _fit_products(frame, knots, member)
    models = {(k, t, m, a): L.solve(products[k], L.design_columns(m == "r1"), t, a) for k in products for t, m in SELECTION for a in plan.alphas}

    def trial_errors(c: Columns) -> dict[int, np.ndarray]:
        own_z, partner_z, flags = L.side_values(c)
        units, out = len(c["fold"]), {}
        for k, at in knots.items():
            left = k % width - 1
            who = (c["set_code"] == k // width) & (c["fold"] == left) if left >= 0 else np.zeros(units, dtype=bool)
            if not who.any():
                continue
            both = np.tile(who, 2)
            design = L.side_design(own_z[both], partner_z[both], flags[both], at)
            sums = [float(who.sum())]
            for t, m in SELECTION:
                y = np.concatenate([c[f"{t}_r"][who], c[f"{t}_l"][who]])
                sums += [float(((y - models[(k, t, m, a)].predict(design)) ** 2).sum() / 2) for a in plan.alphas]
            out[k // width] = out.get(k // width, 0.0) + np.array(sums)
        return out

    columns = ["set_code", "fold", "z_r", "z_l", "flags_r", "flags_l", *[f"{t}_{s}" for t in L.TARGETS for s in "rl"]]
    errors = grouped_sums(frame.select(*columns), trial_errors)
    lines = []
    for s, v in errors.items():
        endpoint, assessed = plan.endpoints[s // plan.folds], s % plan.folds
        for i, (t, m) in enumerate(SELECTION):
            risks = v[1 + i * len(plan.alphas): 1 + (i + 1) * len(plan.alphas)] / v[0]
            best = max(a for a, r in zip(plan.alphas, risks) if r <= risks.min() + TIE)
            lines += [(endpoint, assessed, t, m, a, float(r), a == best) for a, r in zip(plan.alphas, risks)]
    alphas = spark.createDataFrame(lines, "endpoint string, assessed int, target string, model string, alpha double, risk double, chosen boolean")
    final = {(plan.endpoints.index(e) * plan.folds + o, t, m): models[((plan.endpoints.index(e) * plan.folds + o) * width, t, m, a)]
             for e, o, t, m, a, _, ok in lines if ok}

    def assess(c: Columns) -> Columns:
        return _predict_pairs(c, lambda s, t, m: final[(s, t, m)], lambda s: knots[s * width])

    assessed = frame.filter("fold = -1")
    return NestedResult(_prediction_rows(assessed, assess, ["endpoint", "outer_fold", "strength", "method"]), candidates, selected, alphas, table, heads, sets, scores)


def _predict_pairs(c: Columns, model, knots) -> Columns:
    """predicted_<target>_<model>_<side> for every line, set by set."""
    units = len(c["set_code"])
    own, partner, flags = L.side_values(c)
    out = {f"predicted_{t}_{m}_{s}": np.empty(units) for t, m in SELECTION for s in "rl"}
    for s in np.unique(c["set_code"]):
        who = c["set_code"] == s
        both = np.tile(who, 2)
        design = L.side_design(own[both], partner[both], flags[both], knots(s))
        for t, m in SELECTION:
            values = model(s, t, m).predict(design)
            half = len(values) // 2
            out[f"predicted_{t}_{m}_r"][who], out[f"predicted_{t}_{m}_l"][who] = values[:half], values[half:]
    return out


def _prediction_rows(frame: DataFrame, compute, tags: list[str]) -> DataFrame:
    """Loss predictions added to wide lines, then one row per side in the prediction-table layout."""
    keep = [UNIT, *tags, "set_code", *META, *[f"{c}_{s}" for c in ("raw", "p", "z", "y", "nll", "brier") for s in "rl"]]
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    added = [f"predicted_{t}_{m}_{s}" for t, m in SELECTION for s in "rl"]
    schema = ", ".join([f"{k} {types[k]}" for k in keep] + [f"{c} double" for c in added])
    wide = map_columns(frame.select(*keep, "flags_r", "flags_l"), compute, keep, schema)

    def one(code: int, s: str):
        p = F.col(f"p_{s}")
        return F.struct(
            F.lit(code).alias("side"), F.lit("R" if s == "r" else "L").alias("laterality"), F.col(f"device_{s}").alias("device"), F.col(f"q1_{s}").alias("q1"),
            F.col(f"q2_{s}").alias("q2"), F.col(f"raw_{s}").alias("raw_score"), S.sigmoid(F.col(f"raw_{s}")).alias("uncalibrated_prob"), p.alias("prob"), F.col(f"z_{s}").alias("z"),
            F.col(f"y_{s}").alias("label"), F.col(f"nll_{s}").alias("nll"), F.col(f"brier_{s}").alias("brier"), S.confidence(p).alias("confidence"),
            S.predicted_class(p).alias("predicted_class"), S.is_clipped(p).alias("clipped"), *[F.col(f"predicted_{t}_{m}_{s}").alias(f"predicted_{t}_{m}") for t, m in SELECTION])

    return wide.select(UNIT, *tags, F.explode(F.array(one(1, "r"), one(2, "l"))).alias("_s")).select(UNIT, *tags, "_s.*")


# -- final refit and frozen scoring ------------------------------------------------------------------------------


def final_choices(result: NestedResult, plan: Plan) -> DataFrame:
    """Modal choice over outer folds: smaller strength, temperature first, larger alpha on ties."""
    rank = F.array_position(F.array(*map(F.lit, plan.methods)), F.col("method"))
    text = lambda df, what, value: df.select("endpoint", F.lit(what).alias("choice"), F.col(value).cast("string").alias("value"), "times")
    out = text(modal_choice(result.selected, "strength", F.col("strength"), ["endpoint"]), "strength", "strength")
    out = out.unionByName(text(modal_choice(result.selected, "method", rank, ["endpoint"]), "method", "method"))
    alphas = modal_choice(result.alphas.filter("chosen"), "alpha", F.col("alpha").desc(), ["endpoint", "target", "model"])
    return out.unionByName(alphas.select("endpoint", F.concat_ws("_", F.lit("alpha"), "target", "model").alias("choice"), F.col("alpha").cast("string").alias("value"), "times"))


@dataclass
class FrozenStack:
    """Parameter tables of the final refit, one line per fitted object."""

    heads: DataFrame  # endpoint, strength, coefficients, intercept
    calibrators: DataFrame  # endpoint, method, slope, intercept
    losses: DataFrame  # endpoint, target, model, alpha, knots, design, beta

    def tables(self) -> dict[str, DataFrame]:
        return {"heads": self.heads, "calibrators": self.calibrators, "losses": self.losses}


def fit_final(result: NestedResult, plan: Plan) -> FrozenStack:
    """Refit on all development units with the modal choices; the calibrator and loss models are fitted on the
    out-of-fold scores of the outer heads."""
    spark = result.scores.sparkSession
    choice = {(r["endpoint"], r["choice"]): r["value"] for r in final_choices(result, plan).collect()}
    picks = spark.createDataFrame([(e, float(choice[(e, "strength")]), choice[(e, "method")]) for e in plan.endpoints], "endpoint string, strength double, method string")
    oof = result.scores.filter("fold = -1").join(F.broadcast(picks), ["endpoint", "strength"])
    fitted = Q.fit_calibrators(_sides(oof, ["endpoint"]), ["endpoint"], plan.methods).join(F.broadcast(picks.select("endpoint", "method")), ["endpoint", "method"])
    code = (F.array_position(F.array(*map(F.lit, plan.endpoints)), F.col("endpoint")) - 1).cast("int")
    frame = _loss_frame(oof.drop("method").join(F.broadcast(fitted.drop("converged")), "endpoint").withColumn("set_code", code), plan)
    knots = L.subset_knots(frame, ["set_code"], lambda c: {s: c["set_code"] == s for s in np.unique(c["set_code"]).tolist()})
    products = _fit_products(frame, knots, lambda c, k: c["set_code"] == k)
    heads, losses = [], []
    for i, e in enumerate(plan.endpoints):
        strength = float(choice[(e, "strength")])
        w, b = result.heads[(i, 0, strength)].raw()  # training set 0: all units
        heads.append((e, strength, [float(v) for v in w], b))
        for t, m in SELECTION:
            model = L.solve(products[i], L.design_columns(m == "r1"), t, float(choice[(e, f"alpha_{t}_{m}")]))
            losses.append((e, t, m, model.alpha, [float(v) for v in knots[i]], list(L.design_columns(m == "r1")), [float(v) for v in model.beta]))
    return FrozenStack(
        spark.createDataFrame(heads, "endpoint string, strength double, coefficients array<double>, intercept double"), fitted,
        spark.createDataFrame(losses, "endpoint string, target string, model string, alpha double, knots array<double>, design array<string>, beta array<double>"))


def schema_contract(losses: DataFrame) -> DataFrame:
    """R1 may add partner spline columns to R0 and nothing else."""
    by = losses.groupBy("endpoint", "target").agg(
        F.max(F.when(F.col("model") == "r0", F.col("design"))).alias("base"), F.max(F.when(F.col("model") == "r1", F.col("design"))).alias("augmented"))
    added = F.array_except("augmented", "base")
    return by.select("endpoint", "target", added.alias("added"), (
        (F.size(added) > 0) & F.forall(added, lambda c: c.startswith("partner_spline_")) & (F.size(F.array_except("base", "augmented")) == 0)).alias("passed"))


def score_frozen(pairs: DataFrame, stack: FrozenStack, plan: Plan) -> DataFrame:
    """Score wide pairs with the stored parameters. Projections only: no shuffle, no fit, no look at the labels
    beyond computing their losses."""
    heads = F.broadcast(stack.heads.withColumnsRenamed({"intercept": "head_intercept"}))  # one line per endpoint
    calibrators = F.broadcast(stack.calibrators.select("endpoint", "method", "slope", "intercept"))
    position = F.array_position(F.array(*map(F.lit, plan.endpoints)), F.col("endpoint")) - 1
    dot = lambda x: F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), N(0), lambda acc, v: acc + v)
    spread = pairs.withColumn("endpoint", F.explode(F.array(*map(F.lit, plan.endpoints)))).join(heads, "endpoint").join(calibrators, "endpoint")
    lines = spread.select(
        UNIT, *META, "endpoint", "method", "strength", "slope", "intercept", position.cast("int").alias("set_code"), F.lit(-1).alias("outer_fold"),
        *[(dot(F.col(f"x_{s}")) + F.col("head_intercept")).alias(f"raw_{s}") for s in "rl"], *[F.get(f"y_{s}", position.cast("int")).cast("int").alias(f"y_{s}") for s in "rl"])
    frame = L.indicator_arrays(_pair_calibrated(lines), plan.second_device)
    models, knots = {}, {}
    for r in stack.losses.collect():  # endpoints x targets x models lines
        s = plan.endpoints.index(r["endpoint"])
        knots[s] = np.array(r["knots"])
        models[(s, r["target"], r["model"])] = L.LossModel(r["alpha"], r["target"], np.array(r["beta"]))
    return _prediction_rows(frame, lambda c: _predict_pairs(c, lambda s, t, m: models[(s, t, m)], lambda s: knots[s]), ["endpoint", "outer_fold", "strength", "method"])
