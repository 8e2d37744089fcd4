"""Invariants, hand-computed values and refusals of selectors, models, search, explanations, sources and settings."""

import json
import math
import os
import random
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from veyra.functions import dist
from veyra.ml import explain, models, selectors, swarm
from veyra.operators import guard as G
from veyra.operators import ordered
from veyra.operators import resample as R
from veyra.operators import selection as S
from veyra.operators import survey as V
from veyra.sources import codebook, config, manifest, tables
from veyra.streaming.windows import weighted_windows


@pytest.fixture(scope="module")
def rows(spark):
    """Two informative features, one noisy, one constant, with gaps; clusters of ten rows."""
    rng = random.Random(1)
    out = []
    for i in range(300):
        y = int(rng.random() < 0.45)
        out.append((i, i // 10, y, y + rng.gauss(0, 0.7), 2 * y + rng.gauss(0, 1.5) if i % 9 else None, rng.gauss(0, 1), 1.0))
    return spark.createDataFrame(out, "id long, g long, y int, a double, b double, c double, d double").cache()


FEATURES = ["a", "b", "c", "d"]


# ---- orders
def test_cumulated_sums_and_numbers(spark):
    rng = random.Random(3)
    data = [(rng.choice("pq") if i % 7 else None, float(rng.randrange(40)), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, x double, i long").repartition(5)
    got = {r["i"]: r["k"] for r in ordered.numbered(df, ["g"], "x", "k", ["i"]).collect()}
    for g in ("p", "q", None):
        own = sorted((x, i) for h, x, i in data if h == g)
        assert [got[i] for _, i in own] == list(range(len(own)))
    cells = ordered.counted(df, ["g"], "x")
    cuts = {r["g"]: r["cuts"] for r in ordered.quantiles(cells, ["g"], "x", [0, 0.1, 0.37, 0.5, 1]).collect()}
    for g, c in cuts.items():
        assert np.allclose(c, np.quantile([x for h, x, _ in data if h == g], [0, 0.1, 0.37, 0.5, 1]))


# ---- replicates and imputations
def test_replicates_that_are_not_finite_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (3.0, 1.0, 0.0)], "x double, w double, z double")
    w = F.col("w")
    got = V.brr_statistic(df, [], lambda w: F.sum(F.col("x") * w) / F.try_divide(F.sum(w), F.lit(1.0)), w, [w, w * 2, F.lit(float("nan")) * w]).first()
    assert got["n_replicates_used"] == 2 and got["estimate"] == 2 and got["brr_variance"] == 0
    with pytest.raises(Exception, match="fewer than two"):
        V.brr_statistic(df, [], lambda w: F.sum(w), w, [w]).collect()


def test_shares_are_means_of_marks(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, 1.0), ("x", 2.0, 2.0), (None, 4.0, 1.0)], "k string, w double, v double")
    reps = [F.col("w") * F.col("v"), F.col("w") + F.col("v")]
    got = {r["category"]: r for r in V.brr_shares(df, [], F.col("k"), ["x", "y", "z"], F.col("w"), reps).collect()}
    for c in "xyz":
        want = V.brr(df, [], F.coalesce((F.col("k") == c).cast("double"), F.lit(0.0)), F.col("w"), reps).first()
        assert math.isclose(got[c]["estimate"], want["estimate"]) and math.isclose(got[c]["brr_se"], want["brr_se"], abs_tol=1e-12)


def test_factors_of_clusters_give_the_same(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randrange(6), rng.gauss(0, 1) if i % 5 else None, i % 2, 1.0 + i % 3) for i in range(200)], "feature string, psu int, value double, y int, w double")
    factors = [F.when((F.col("psu") * r) % 5 % 2 == 0, 1.5).otherwise(0.5) for r in range(1, 9)]
    whole = [F.col("w") * f for f in factors]
    for one, two in ((V.brr(df, ["feature"], F.col("value"), F.col("w"), whole), V.brr(df, ["feature"], F.col("value"), F.col("w"), factors, cluster="psu")), (S.group_differences(df, "y", F.col("w"), whole), S.group_differences(df, "y", F.col("w"), factors, "psu"))):
        a, b = ({r["feature"]: r for r in x.collect()} for x in (one, two))
        assert all(math.isclose(a[f]["brr_se"], b[f]["brr_se"], rel_tol=1e-9) and math.isclose(a[f][c], b[f][c], rel_tol=1e-9) for f in "ab" for c in ("ci_low", "ci_high"))


def test_rubin_intervals(spark):
    df = spark.createDataFrame([("u", e, 0.25) for e in (6.0, 7.0, 9.0, 10.0)] + [("v", 0.5, 0.01)], "g string, e double, v double")
    u, v = V.rubin_intervals(df, ["g"], "e", "v").orderBy("g").collect()
    assert math.isclose(u["ci_high"] - u["q_bar"], dist.t_ppf(0.975, u["df"]) * u["se"]) and u["ci_low"] < 8 < u["ci_high"]
    assert v["df"] == math.inf and v["fmi"] == 0 and math.isclose(v["ci_high"], 0.5 + 1.959963984540054 * 0.1)


def test_plausible_value_categories(spark):
    df = spark.createDataFrame([(1.0, 5.0, "old")], "PV1M double, PV2M double, cat_pv9 string")
    got = V.pv_categories(df, "PV{i}M", 2, (2.0, 4.0), ("L", "M", "H"))
    assert got.columns == ["PV1M", "PV2M", "cat_pv1", "cat_pv2"] and got.first()[2:] == ("L", "H")
    assert V.task_rows(got, "cat_pv2", "L", "H").first()["y"] == 1 and V.task_rows(got, "cat_pv2", "L", "M").count() == 0
    with pytest.raises(KeyError):
        V.pv_categories(df, "PV{i}M", 3, (2.0,), ("L", "H"))


# ---- tests and contrasts
def test_signed_rank():
    assert dist.wilcoxon([1.0, 2.0, 3.0, 4.0, 5.0]) == (0.0, 0.0625) and dist.wilcoxon([1.0, -2.0, 3.0])[1] == 0.75
    w, p = dist.wilcoxon([1.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 5.0] * 4)
    assert 0 < p < 0.05 and math.isnan(dist.wilcoxon([0.0])[1])


def test_contrast_table(spark):
    rng = random.Random(2)
    folds = [("t", m, f, 0.7 + d + rng.gauss(0, 0.01)) for m, d in (("ref", 0), ("same", 0.0), ("worse", -0.2)) for f in range(10)] + [("t", "lonely", 99, 0.5), ("t", "worse", 50, None)]
    df = spark.createDataFrame(folds, "task string, method string, fold int, auc double")
    got = {r["method"]: r for r in S.contrast_table(df, ["fold"], "method", "auc", "ref", 0.25, by=["task"]).collect()}
    assert set(got) == {"same", "worse"} and got["worse"]["significant"] and not got["same"]["significant"] and got["worse"]["df"] == 9
    assert math.isclose(got["worse"]["p_adj"], min(1, 2 * got["worse"]["p"])) and got["worse"]["ci_high"] < 0
    t = got["worse"]["t_corrected"]
    assert math.isclose(abs(t) * math.sqrt(0.1 + 0.25), abs(got["worse"]["t_plain"]) * math.sqrt(0.1)) and math.isclose(got["worse"]["p"], dist.two_sided_p(t, 9))
    with pytest.raises(ValueError):
        S.contrast_table(df, ["fold"], "method", "auc", "ref", None)
    with pytest.raises(ValueError):
        S.contrast_table(df, ["fold"], "method", "auc", "ref", 0.25, test="sign")


def test_weighted_difference_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0, 1.0), (3.0, 0, 1.0), (2.0, 1, 2.0), (6.0, 1, 2.0)], "x double, g int, w double")
    long = df.select(F.lit("f").alias("feature"), F.col("x").alias("value"), "g", "w")
    got = S.group_differences(long, "g", F.col("w")).first()
    assert math.isclose(got["d"], (4 - 2) / math.sqrt((3 * 4 + 1 * 1) / 4)) and got["band"] == "large"
    assert S.group_differences(long.where("g = 1 or value = 1"), "g", F.col("w")).first()["d"] is None


# ---- guards
def test_guard_and_allowlist(spark):
    assert set(G.forbidden(["ESCS_z", "ST004D01T_2.0", " math_score", "log_math_score", "missingindicator_PV1MATH"])) == {"ESCS_z", " math_score", "log_math_score", "missingindicator_PV1MATH"}
    with pytest.raises(G.LeakageError, match="derived form"):
        G.assert_no_leakage(["z_math_score"], where="here")
    with pytest.raises(ValueError):
        G.assert_no_leakage(None)
    entry = {"block": "b", "justification": "because"}
    allowed = G.Allowlist({"ST1": entry, "ST2": entry | {"signed_off_by": "me"}})
    assert allowed.expand(["ST2", "ST1_1.0", "ST1_2.0", "ST10"]) == ["ST1_1.0", "ST1_2.0", "ST2"] and allowed.signed_off == {"ST2"} and allowed.to_frame(spark).count() == 2
    with pytest.raises(G.LeakageError):
        G.Allowlist({"PV1MATH": entry})
    with pytest.raises(ValueError):
        G.Allowlist({"ST1": {"justification": " "}})


def test_design_matrix(spark):
    df = spark.createDataFrame([("1", 2, "x"), ("no", 3, "y")], "ST1 string, ST2 int, PV1MATH string")
    got = G.design_matrix(df, ["ST1", "ST2"])
    assert got.dtypes == [("ST1", "double"), ("ST2", "double")] and [r[0] for r in got.collect()] == [1.0, None]
    assert G.design_matrix(df, ["ST1"], noise_seed=1).columns == ["ST1", "noise_control"]
    with pytest.raises(KeyError):
        G.design_matrix(df, ["ST9"])
    with pytest.raises(G.LeakageError):
        G.design_matrix(df, ["PV1MATH"])
    assert G.design_matrix(df, ["ST9", "ST1"], strict=False).columns == ["ST1"]


def test_screen_flags_the_outcome(spark, rows):
    long = S.unpivot(rows.withColumn("copy", -F.col("y").cast("double")), ["y"], ["a", "d", "copy"])
    with pytest.raises(G.LeakageError, match="copy"):
        G.single_variable_screen(long, "y")
    got = {r["feature"]: r for r in G.single_variable_screen(long, "y", signed_off=["copy"]).collect()}
    assert got["copy"]["flagged"] and got["copy"]["auc"] == 1 and got["copy"]["auc_signed"] == 0 and got["d"]["auc"] is None and not got["a"]["flagged"]


def test_preparation_learns_from_training_rows_only(spark, rows):
    train, test = rows.where("g < 15"), rows.where("g >= 15").withColumn("b", F.lit(None).cast("double"))
    prepared = G.Preparation(train, ["a", "b", "d"])
    values = sorted(r[0] for r in train.where("b is not null").select("b").collect())
    assert math.isclose(prepared.medians["b"], float(np.median(values))) and prepared.names == ["a", "b", "d", "missingindicator_b"]
    got = prepared.apply(test).select("b", "missingindicator_b", "d").distinct().collect()
    m, s = prepared.moments["b"]
    assert len(got) == 1 and math.isclose(got[0][0], (prepared.medians["b"] - m) / s) and got[0][1] > 0 and got[0][2] == 0


# ---- resampling
def test_grouped_folds(spark, rows):
    table = models.repeated_splits(rows, "g", "y", 5, 2)
    assert table.count() == 60 and table.groupBy("repeat", "g").count().where("count > 1").count() == 0
    shares = rows.join(table.where("repeat = 0"), "g").groupBy("fold").agg(F.avg("y").alias("p"), F.count("*").alias("n")).collect()
    assert len(shares) == 5 and max(r["p"] for r in shares) - min(r["p"] for r in shares) < 0.2
    with pytest.raises(ValueError):
        models.fold_table(rows.where("g < 3"), "g", "y", 5, 0)
    with pytest.raises(ValueError):
        G.assert_disjoint(rows, rows.limit(3), "g")


def test_permuted_labels_keep_groups(spark, rows):
    a = G.permute_within(rows.select("id", "g", "y"), ["g"], "y", "id", 1)
    b = G.permute_within(rows.select("id", "g", "y").repartition(7), ["g"], "y", "id", 1)
    assert sorted(a.select("id", "y").collect()) == sorted(b.select("id", "y").collect()) != sorted(rows.select("id", "y").collect())
    total = lambda df: {r[0]: r[1] for r in df.groupBy("g").agg(F.sum("y")).collect()}
    assert total(a) == total(rows) and total(G.permute_within(rows.select("id", "g", "y"), [], "y", "id", 1)) != total(rows)


def test_null_and_gate(spark, rows):
    fit = lambda df, seed: V.auc(df, [], "y", "a").first()[0]
    base = rows.select("id", "g", "y", "a")
    null = R.permutation_null(fit, base, "y", "id", fit(base, 0), n=5)
    assert null["p"] == 1 / 6 and null["n_permutations"] == 5 and abs(null["mean"] - 0.5) < 0.06
    R.assert_null_is_chance(null, tolerance=0.1)
    with pytest.raises(ValueError):
        R.assert_null_is_chance(null | {"within_groups": True})
    with pytest.raises(G.LeakageError):
        R.assert_null_is_chance(null | {"mean": 0.7})
    assert "distribution" not in R.permutation_table(spark, [null]).columns


def test_bootstrap_states(spark, rows):
    got = R.cluster_interval(rows, "g", "y", "a", replicates=60)
    assert got["ci_low"] < got["estimate"] < got["ci_high"] and got["method"] == "bca" and got["n_clusters"] == 30
    assert R.cluster_interval(rows, "g", "y", "a", replicates=5)["method"] == "failed"
    assert R.cluster_interval(rows, "g", "y", "a", replicates=30, method="percentile")["method"] == "percentile"


def test_local_instances(spark, rows):
    scored = rows.select("id", "y", (1 / (1 + F.exp(-F.col("a")))).alias("s")).cache()
    few, rule = R.local_instances(scored, "s", "y", "id", n=6)
    assert 3 <= few.count() <= 6 and "slices" in rule
    assert R.local_instances(scored, "s", "y", "id", strategy="extremes")[0].count() == 2
    both = R.local_instances(scored, "s", "y", "id", n=6, strategy="correct_and_errors")[0].collect()
    assert sum((r["s"] >= 0.5) == r["y"] for r in both) == 3 and len(both) == 6
    with pytest.raises(ValueError):
        R.local_instances(scored, "s", "y", "id", strategy="best")
    assert R.stratified_sample(rows, "y", "id", 50).count() == 50


# ---- selectors, models, search
def test_selectors(spark, rows):
    for chosen in (selectors.SymmetricUncertainty(2), selectors.MutualInformation(2), selectors.ReliefF(2, samples=80)):
        got = chosen.fit(rows, FEATURES, "y", "id")
        assert set(got.selected_) == {"a", "b"}, type(chosen)
        assert got.transform(rows, ["id"]).columns == ["id", *got.selected_] and got.report()["n_selected"] == 2
    assert selectors.Identity().fit(rows, FEATURES, "y").selected_ == FEATURES
    none = selectors.ChiSquared(0, min_features=2)
    none.choose = lambda scores: []
    assert len(none.fit(rows, FEATURES, "y").selected_) == 2
    with pytest.raises(G.LeakageError):
        selectors.ChiSquared(1).fit(rows.withColumn("ESCS", F.lit(1.0)), ["a", "ESCS"], "y")
    with pytest.raises(ValueError):
        selectors.ReliefF(1).fit(rows, FEATURES, "y")


def test_registry(spark):
    every = models.get_models(fast=True)
    assert {"LogisticRegression_L2", "LogisticRegression_L1", "DecisionTree", "RandomForest", "GradientBoosting", "LinearSVC", "SVM", "MLP"} <= set(every)
    with pytest.raises(KeyError):
        models.get_models(["nothing"])
    with pytest.raises(AttributeError):
        models.score_matrix(object(), None)


@pytest.mark.parametrize("name", ["LogisticRegression_L1", "DecisionTree", "RandomForest", "GradientBoosting", "LinearSVC", "SVM", "MLP"])
def test_models_fit_and_score(spark, rows, name):
    spec = models.get_models([name], fast=True)[name]
    params = {k: v[0] for k, v in spec.grid.items()} | ({"numTrees": 5} if name == "RandomForest" else {"maxIter": 5} if name == "GradientBoosting" else {})
    fitted = models.Fitted(rows, FEATURES, "y", spec, params, None)
    scored = fitted.score(rows)
    assert scored.columns == [*rows.columns, "score"] and V.auc(scored, [], "y", "score").first()[0] > 0.75
    assert scored.where("b is null").count() == rows.where("b is null").count()  # its own columns stay


def test_nested_folds_are_kept_and_resumed(spark, rows, tmp_path):
    spec = models.Spec(models.get_models(["LogisticRegression_L2"])["LogisticRegression_L2"].make, {"C": [1]})
    cfg = models.NestedCV(outer_splits=2, outer_repeats=1, inner_splits=2)
    store = tables.FoldStore(spark, f"file://{tmp_path}/folds")
    run = lambda df, **k: models.run_nested(df, ["a", "b", "c"], "y", "g", {"lr": spec}, cfg, selector=lambda: selectors.SymmetricUncertainty(2), key="id", task="t", method="m", store=store, **k)
    first = run(rows, weight="d")
    assert len(first) == 2 and all(r["auc"] > 0.75 and r["selected"] == ["a", "b"] and math.isclose(r["auc"], r["w_auc"]) and r["n_train"] + r["n_test"] == 300 for r in first)
    again = run(rows, weight="d")
    assert [r["fit_seconds"] for r in again] == [r["fit_seconds"] for r in first]
    mark = first[0]["cfg_fingerprint"]
    preds = store.predictions(mark)
    assert preds.count() == 300 and {"y_true", "y_score", "group", "rep", "fold"} <= set(preds.columns)
    keys = spark.createDataFrame([("t", 1, "m", 0, f) for f in range(3)], "task string, pv int, method string, rep int, fold int")
    assert [r["fold"] for r in store.pending(mark, keys).collect()] == [2]
    other = models.row_signature(rows.withColumn("a", F.col("a") + 1), "y", "g", ["a"])
    assert other != models.row_signature(rows, "y", "g", ["a"]) == models.row_signature(rows.repartition(3), "y", "g", ["a"])
    prints = {models.fingerprint(cfg, ["lr"], s, ["a"], w, other) for s in (None, selectors.ChiSquared(3), selectors.ChiSquared(4)) for w in (True, False)}
    assert len(prints) == 6
    with pytest.raises(G.LeakageError):
        models.run_nested(rows, ["a", "math_score"], "y", "g", {}, cfg)
    with pytest.raises(FileNotFoundError):
        tables.FoldStore(spark, f"file://{tmp_path}/none").predictions()


def test_stump_finds_the_outcome(spark, rows):
    leaky = rows.withColumn("leak", F.col("y") * 10 + F.col("id") % 7).withColumn("fold", F.col("id") % 3)
    assert models.stump(leaky, "leak", "y").first()["accuracy"] == 1 and models.stump_accuracy(leaky, "leak", "y", "fold", 3) == 1
    assert models.stump_accuracy(leaky, "c", "y", "fold", 3) < 0.75


SMALL = dict(population_size=6, max_iter=4, fitness_subsample=200, c1=1.5)


def test_swarms_find_the_features(spark, rows):
    data = rows.fillna(0.0)
    one, two = (swarm.BinarySwarm(**SMALL, max_cardinality=2, seed=3).fit(data, FEATURES, "y", "id") for _ in range(2))
    assert one.selected_ == two.selected_ and len(one.selected_) <= 2 and {"a", "b"} & set(one.selected_)
    best = [c["best_fitness"] for c in one.convergence_]
    assert best == sorted(best) and one.algorithm_report()["n_selected"] == len(one.selected_) and one.convergence_frame(spark).count() == len(best)
    long = swarm.VariableLengthSwarm(**SMALL, beta_stagnation=1, divisions=2).fit(data, FEATURES, "y", "id")
    assert {"a", "b"} & set(long.selected_) and len({n for h in long.length_history_ for n in h}) > 1 and all(2 <= n <= 4 for h in long.length_history_ for n in h)
    assert long.fitness([np.zeros(4, bool)])[0] == -np.inf and "neighbours" in long.complexity()


def test_swarm_refuses_vain_settings():
    for bad in ({"beta_stagnation": 9, "max_iter": 9}, {"length_direction": "up"}, {"init": "x"}, {"ranking": "x"}, {"exemplar_fallback": "x"}, {"fitness_cv_splits": 1}):
        with pytest.raises(ValueError):
            swarm.VariableLengthSwarm(**bad).validate()


def test_lengths_grow_and_shrink():
    s = swarm.VariableLengthSwarm(length_step=2, min_length=2)
    s.longest_ = 6
    rng = np.random.default_rng(0)
    particle = lambda n, v: {"at": np.full(n, 0.4), "v": np.ones(n), "memory": np.full(n, 0.4), "value": v, "idle": 0}
    p, donor = particle(3, 0.1), {**particle(6, 0.9), "at": np.full(6, 0.8)}
    s.grow(p, [p, donor, {**particle(6, 0.2), "at": np.full(6, 0.1)}], rng)
    assert p["at"].tolist() == [0.4] * 3 + [0.8] * 2 and p["v"][3:].tolist() == [0, 0] and len(p["memory"]) == 5
    s.shrink(p)
    s.shrink(p)
    assert len(p["at"]) == 2 and len(p["memory"]) == 5
    assert s.exemplar([donor, p], p, 5) == 0.4 and np.isnan(swarm.VariableLengthSwarm(exemplar_fallback="inertia").exemplar([donor], p, 0))


# ---- explanations
def test_shapley_values_add_up(spark, rows):
    data = rows.fillna(0.0).select("id", "y", "a", "b", "c")
    weights = {"a": 2.0, "b": -1.0, "c": 0.5}
    model = lambda t: t.withColumn("score", sum((F.lit(w) * F.col(f) for f, w in weights.items()), F.lit(1.0)))
    base = explain.background(data, list(weights), "id", 10, "random")
    few = data.where("id < 20")
    exact = {(r["instance"], r["feature"]): r["shap_value"] for r in explain.linear_shap(few, weights, base, "id").collect()}
    drawn = explain.sampled_shap(few, model, base, list(weights), "id", permutations=40)
    got = {(r["instance"], r["feature"]): r["shap_value"] for r in drawn.collect()}
    assert set(got) == set(exact) and np.mean([abs(got[k] - exact[k]) for k in got]) < 0.4
    crossed = lambda t: t.withColumn("score", F.col("a") * F.col("b"))  # noqa: E731  an interaction
    one = explain.sampled_shap(few, crossed, base.limit(1), list(weights), "id", permutations=4)
    b = base.limit(1).first()
    for r in few.collect():
        total = sum(x["shap_value"] for x in one.where(F.col("instance") == r["id"]).collect()) if r["id"] < 3 else None
        assert total is None or math.isclose(total, r["a"] * r["b"] - b["a"] * b["b"], abs_tol=1e-9)
    out = explain.global_shap(model, data, data, list(weights), "y", "id", n_instances=30, background_size=5, n_bootstrap=50, coefficients=weights)
    top = out["importance"].orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and all(r["ci_low"] <= r["mean_abs_shap"] <= r["ci_high"] for r in top) and out["spec"].row()["background_source"] == "train" and out["spec"].n_explained == 30


def test_feature_space_is_checked(spark, rows):
    with pytest.raises(TypeError):
        explain.check_space(types.SimpleNamespace(preparation=1), ["a"])
    with pytest.raises(ValueError):
        explain.check_space(types.SimpleNamespace(numFeatures=3), ["a"])
    with pytest.raises(ValueError):
        explain.background(rows, ["a"], "id", method="x")


def test_surrogates_follow_the_model(spark, rows):
    data = rows.fillna(0.0).select("id", "y", "a", "b", "c")
    model = lambda t: t.withColumn("score", 3 * F.col("a") - 0.1 * F.col("c"))
    weights = explain.local_surrogates(data.where("id < 2"), model, data, ["a", "b", "c"], "id", n_repeats=3, n_samples=200)
    each, stability = explain.surrogate_stability(weights)
    size = {(r["instance"], r["feature"]): abs(r["weight_mean"]) for r in each.collect()}
    assert all(size[i, "a"] > 5 * size[i, "b"] for i in (0, 1)) and {r["n_repeats"] for r in stability.collect()} == {3}
    shap = spark.createDataFrame([("a", 3.0, 1), ("c", 0.1, 2), ("b", 0.01, 3)], "feature string, mean_abs_shap double, rank int")
    got = explain.rank_agreement(shap, each, 2).first()
    assert got["n_features"] == 3 and got["top_k_overlap"] >= 1
    assert explain.rank_agreement(shap.limit(2), each, 2).first()["spearman_rho"] is None
    assert explain.noise_benchmark(shap, "c").first()["features_below_noise"] == "b" and not explain.noise_benchmark(shap, "none").first()["available"]
    names = spark.createDataFrame([("a", "Age")], "item string, label string")
    long = explain.linear_shap(data.where("id = 1"), {"a": 3.0, "c": 0.1}, explain.background(data, ["a", "c"], "id", 5, "random"), "id")
    assert [r["label"] for r in explain.top_contributors(long, 1, 2, names).collect()] in (["Age", "c"], ["c", "Age"]) and "cause" in explain.CAUSAL_CAVEAT


def test_permutation_importance(spark, rows):
    model = lambda t: t.withColumn("score", F.col("a"))
    got = explain.permutation_importance(model, rows.select("id", "y", "a", "c"), ["a", "c"], "y", "id", repeats=2)
    drop = {r["feature"]: r["perm_importance"] for r in got.collect()}
    assert drop["a"] > 0.2 and drop["c"] == 0
    assert explain.permutation_agreement(spark.createDataFrame([("a", 2.0), ("c", 1.0)], "feature string, mean_abs_shap double"), got).first()["spearman_rho"] == pytest.approx(1.0)


# ---- sources
def test_extract_cache_and_sinks(spark, tmp_path):
    src = spark.createDataFrame([("ESP", 1.0, None), ("PRT", float("nan"), "x"), ("FRA", 1.0, "y")], "CNT string, a double, b string")
    got = {r["CNT"]: r["n_missing_allcols"] for r in tables.analytic_frame(src, "CNT", ["ESP", "PRT", "ESP"]).collect()}
    assert got == {"ESP": 1, "PRT": 1}
    path, calls = f"file://{tmp_path}/cache", []
    make = lambda: calls.append(1) or src
    assert [tables.read_through(spark, path, make, force=f).count() for f in (False, False, True)] == [3, 3, 3] and len(calls) == 2
    side = tables.verification_extract(src, ["a", "zz"], "CNT", ["ESP"], f"file://{tmp_path}/ex", labels={"a": "Age", "zz": "no"})
    assert side["absent"] == ["zz"] and side["labels"] == {"a": "Age"} and spark.read.parquet(f"file://{tmp_path}/ex").columns == ["a"]
    tables.verification_extract(src, ["CNT"], "CNT", ["ESP"], f"file://{tmp_path}/ex.csv", fmt="csv")
    assert tables.read_table(spark, f"file://{tmp_path}/ex.csv").count() == 1
    with pytest.raises(FileNotFoundError, match="isn't there"):
        tables.require(spark, f"file://{tmp_path}/nothing")
    out = tables.emit(spark.createDataFrame([("a_b", 0.12345, None)], "the_name string, v double, n int"), "tab", f"file://{tmp_path}/rep", caption="50% & more")
    tex = "\n".join(r[0] for r in spark.read.text(out["tex"], wholetext=True).collect())
    assert "the name & v & n" in tex and r"a\_b & 0.1235 & " in tex and r"50\% \& more" in tex and "{lrr}" in tex
    assert tables.escape_tex("\\{~^}#$") == r"\textbackslash{}\{\textasciitilde{}\textasciicircum{}\}\#\$"


def test_spss_by_ranges(spark, tmp_path, monkeypatch):
    fake = tmp_path / "pyreadstat.py"
    fake.write_text("import pandas as pd, types\nF = pd.DataFrame({'a': [float(i) for i in range(10)], 'c': ['x'] * 10})\ndef read_sav(path, metadataonly=False, usecols=None, row_offset=0, row_limit=0):\n    m = types.SimpleNamespace(readstat_variable_types={'a': 'double', 'c': 'string'}, number_rows=10)\n    return (None, m) if metadataonly else (F[usecols].iloc[row_offset:row_offset + row_limit], m)\n")
    with pytest.raises(ImportError, match="pyreadstat"):
        tables._pyreadstat()
    monkeypatch.syspath_prepend(str(tmp_path))
    source = tables.SpssSource({"path": "x.sav", "rows_per_partition": "4"})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    assert [(p.offset, p.limit) for p in parts] == [(0, 4), (4, 4), (8, 2)] and [r for p in parts for r in reader.read(p)] == [(float(i), "x") for i in range(10)]
    sys.modules.pop("pyreadstat", None)


def test_manifests(spark, tmp_path):
    for n, t in (("a.txt", "one"), ("d/b.txt", "two")):
        (tmp_path / "r" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / n).write_text(t)
    made = manifest.write_manifest(spark, f"file://{tmp_path}/r", run="x")
    import hashlib

    assert made["files"] == {n: {"sha256": hashlib.sha256(t.encode()).hexdigest(), "bytes": 3} for n, t in (("a.txt", "one"), ("d/b.txt", "two"))} and made["run"] == "x"
    assert json.loads((tmp_path / "r" / "manifest.json").read_text())["n_files"] == 2 and manifest.file_digests(spark, f"file://{tmp_path}/r").count() == 2


PAGE = """CY7_201709_QST
How far do you agree?
ST034
(Please select one response in each row.)
Strongly agree Agree Disagree
I feel like an outsider. ST034Q01TA
01 02 03
I make friends easily. ST034Q02TA
at my school
04 05 06
[Filter: all]
12"""


def test_questionnaire_pages(spark):
    pages = spark.createDataFrame([(3, PAGE), (9, "ST034\nST034Q01TA Another wording"), (4, "nothing here\n7"), (5, None)], "page int, text string")
    got = {r["item"]: r for r in codebook.extract_items(pages).collect()}
    a, b = got["ST034Q01TA"], got["ST034Q02TA"]
    assert set(got) == {"ST034Q01TA", "ST034Q02TA"} and a["page"] == 3 and a["block"] == "ST034" and a["question_stem"] == "How far do you agree?"
    assert a["item_label"] == "I feel like an outsider." and a["response_codes_raw"] == "01 02 03" and a["response_scale"] == "Strongly agree Agree Disagree" and not a["needs_review"]
    assert b["item_label"] == "I make friends easily." and b["filter_note"] == "[Filter: all]" and a["instruction"].startswith("(Please")


def test_codebook_precedence(spark):
    extracted = {"items": {"ST1Q1": {"block": "ST1", "question_stem": "auto", "item_label": "auto label", "page_pdf": 2}, "ST2Q1": {"block": "ST2"}}}
    over = {"items": {"ST1Q1": {"label": "hand label", "reverse_scored": True}}, "blocks": {"ST1": {"question_stem": "hand stem", "scale_type": "likert", "response_categories": {1: "no"}}}, "non_questionnaire": {"PV1MATH..PV10MATH": {"role": "outcome"}, "CNT / CYC": {"role": "id"}}}
    book = codebook.Codebook(spark, extracted, over, {"ST1Q1": {1.0: "never"}}, {"ST2Q1": "spss label", "ST1Q1": "not used"})
    names = spark.createDataFrame([("ST1Q1_1.0",), ("ST2Q1",), ("PV7MATH",), ("CYC",), ("ODD",)], "item string")
    got = {r["item"]: r for r in book.describe(names).collect()}
    one = got["ST1Q1_1.0"]
    assert (one["label"], one["question_stem"], one["scale_type"], one["page_pdf"], one["reverse_scored"]) == ("hand label", "hand stem", "likert", 2, True)
    assert json.loads(one["response_categories"]) == {"1.0": "never"} and one["source"] == "instrument_pdf+hand_verified+spss_metadata"
    assert got["ST2Q1"]["label"] == "spss label" and got["PV7MATH"]["role"] == "outcome" and got["CYC"]["role"] == "id" and got["ODD"]["source"] == "undocumented"
    book.require_documented(names.where("item <> 'ODD'"))
    with pytest.raises(codebook.UndocumentedError, match="ODD"):
        book.require_documented(names)
    assert "p. 2" in book.citation(names.limit(1)).first()["citation"] and {r["item"]: r["label"] for r in book.label(names).collect()}["ODD"] == "ODD"


def test_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "c.yaml").write_text("seeds: {base: 7}\ncv: {outer: 5}\n")
    cfg = config.Config.load(str(tmp_path / "config" / "c.yaml"), cv__outer=3)
    other = config.Config.load(str(tmp_path / "config" / "c.yaml"))
    assert cfg.section("cv") == {"outer": 3} and cfg.seeds(3) == [7, 8, 9] and cfg.hash() != other.hash() == config.Config.load(str(tmp_path / "config" / "c.yaml")).hash()
    with pytest.raises(KeyError):
        cfg.section("none")
    assert config.project_root(start=str(tmp_path / "config")) == tmp_path
    monkeypatch.setenv("VEYRA_ROOT", "/x")
    assert str(config.project_root()) == "/x" and config.Config({}).paths.results == os.path.join("/x", "results")
    config.set_global_seeds(1)
    assert "python" in config.environment_report(spark)


# ---- streams
def test_windows_of_a_stream_and_a_table(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    out = weighted_windows(stream, "ts", "value", None, ["event_type"], width="1 day", late="400 days")
    run = out.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    plain = lambda t: sorted((str(r["start"]), r["event_type"], r["n"], round(r["wmean"], 6)) for r in t.collect())
    assert plain(spark.table("windows")) == plain(weighted_windows(df, "ts", "value", None, ["event_type"], width="1 day"))
