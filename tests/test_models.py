import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from premiumscope.operators import joint, metrics, models, search
from premiumscope.operators.scaling import fit_scaling
from premiumscope.operators.split import stratified_folds

COMPONENTS = ["PrimaRC", "PrimaCasco"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (f"k{n:02d}", "XYX"[n // 8], "ABB"[n // 8], 2.0 * n + 1, 40.0 + 3 * n, 7.0 + n % 8)
        for n in range(24)
    ]
    schema = "NroPoliza string, Pol6TTaCod string, CoberturaLabel string, `Fea.ture` double, PrimaRC double, PrimaCasco double"
    return spark.createDataFrame(data, schema).withColumn("Prima", F.expr("PrimaRC + PrimaCasco")).cache()


@pytest.mark.parametrize("kind, params", [("random_forest", {"n_estimators": 3, "max_depth": None}), ("extra_trees", {"n_estimators": 3}), ("tweedie", {"weight_decay": 0.01}), ("pytorch", {"max_epochs": 5})])
def test_families_are_nonnegative_and_survive_saving(spark, rows, tmp_path, kind, params):
    scaler = "robust" if kind in models.SMOOTH else "none"
    model = models.fit_spark_model(rows, ["Fea.ture"], COMPONENTS, kind, scaler, params)
    outputs = models.component_outputs(COMPONENTS)
    scored = model.score(rows, outputs)
    assert set(scored.columns) == {*rows.columns, *outputs.values()}
    first = sorted(map(tuple, scored.collect()))
    assert all(value >= 0 for row in first for value in row[-2:])
    models.save_scorer(model, str(tmp_path / "m"))
    loaded = models.load_scorer(spark, str(tmp_path / "m"))
    assert type(loaded) is type(model)
    assert loaded.features == ["Fea.ture"] and loaded.components == COMPONENTS
    assert sorted(map(tuple, loaded.score(rows, outputs).collect())) == first


def test_configuration_names_are_translated():
    found = models.estimator_parameters("random_forest", {"n_estimators": 350, "max_depth": 48, "max_features": 0.7, "max_samples": None, "criterion": "squared_error", "min_samples_split": 2, "n_jobs": -1, "min_samples_leaf": 3})
    assert (found["numTrees"], found["maxDepth"], found["featureSubsetStrategy"], found["subsamplingRate"], found["bootstrap"], found["minInstancesPerNode"]) == (350, 30, "0.7", 1.0, True, 3)
    assert models.estimator_parameters("extra_trees", {})["bootstrap"] is False
    assert models.estimator_parameters("extra_trees", {"n_estimators": 9})["numTrees"] == 9
    network = {"hidden_units": 64, "hidden_layers": 2, "learning_rate": 0.001, "weight_decay": 1e-5, "batch_size": 256, "final_weight": 0.25, "max_epochs": 250, "patience": 25}
    assert models.estimator_parameters("pytorch", network) == {"weight_decay": 1e-5, "max_epochs": 250, "final_weight": 0.25}
    assert set(models.adjusted_parameters("pytorch", network)) == {"hidden_units", "hidden_layers", "learning_rate", "batch_size", "patience"}
    assert models.adjusted_parameters("random_forest", {"max_depth": 48, "criterion": "x"}) == {"criterion": "no effect", "max_depth": "48 becomes 30"}
    assert models.adjusted_parameters("extra_trees", {"max_depth": 12}) == {}
    with pytest.raises(ValueError, match="no parameters"):
        models.estimator_parameters("random_forest", {"nope": 1})
    with pytest.raises(ValueError, match="no model family"):
        models.estimator_parameters("boosting", {})


def test_scalers_are_exact(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(5, 3, 900), rng.integers(0, 40, 900).astype(float)
    df = spark.createDataFrame([(float(a), float(b), 2.5, None) for a, b in zip(x, y)] + [(None, None, None, None)], "x double, y double, c double, n double")
    for kind, centre, spread in (
        ("standard", np.mean, np.std), ("minmax", np.min, np.ptp),
        ("robust", np.median, lambda v: np.subtract(*np.quantile(v, [0.75, 0.25]))),
    ):
        found = fit_scaling(df, ["x", "y", "c", "n"], kind)
        for name, values in (("x", x), ("y", y)):
            assert found.centre[name] == pytest.approx(centre(values)) and found.spread[name] == pytest.approx(spread(values))
        assert {r["c"] for r in found.apply(df).collect()} == {0.0, None} and found.spread["n"] == 1.0
    with pytest.raises(ValueError, match="unknown scaler"):
        fit_scaling(df, ["x"], "log")


def test_trees_without_row_draws_differ(spark):
    rng = np.random.default_rng(2)
    data = [(float(a), float(b), float(a * 3 + b * b)) for a, b in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(data, "a double, b double, PrimaRC double").cache()
    params = {"n_estimators": 5, "max_depth": 5, "bootstrap": False, "max_features": 1.0}
    scorer = models.fit_spark_model(df, ["a", "b"], ["PrimaRC"], "extra_trees", params=params)
    forest = scorer.pipeline.stages[-1]
    assert len({tree.toDebugString.split("\n", 1)[1] for tree in forest.trees}) == 5
    again = models.fit_spark_model(df, ["a", "b"], ["PrimaRC"], "extra_trees", params=params)
    assert again.pipeline.stages[-1].toDebugString.split("\n", 1)[1] == forest.toDebugString.split("\n", 1)[1]
    error = scorer.score(df, {"PrimaRC": "p"}).selectExpr("avg(pow(p - PrimaRC, 2)) / var_pop(PrimaRC)").first()[0]
    assert error < 0.2


def _balanced(df, names):
    return metrics.balanced_mse(df, COMPONENTS, names, 0.5).first()[0]


def test_joint_fit_lowers_the_shared_loss(spark):
    """Components that make up for each other: a joint fit beats one fit per component on the balanced error."""
    rng = np.random.default_rng(3)
    n = 1500
    x, g = rng.normal(size=(n, 2)), rng.integers(0, 6, n)
    level = np.exp(0.4 * x[:, 0] - 0.2 * x[:, 1] + np.array([0.0, 0.3, -0.4, 0.8, 0.1, -0.2])[g])
    share = 1 / (1 + np.exp(2 * x[:, 1] ** 2 - 1))
    rows = [(float(a), float(b), [int(k)], float(100 * v * s), float(100 * v * (1 - s))) for (a, b), k, v, s in zip(x, g, level, share)]
    df = spark.createDataFrame(rows, "a double, b double, g array<long>, PrimaRC double, PrimaCasco double").repartition(4).cache()
    blocks = [joint.Block("g", 6)]
    both = joint.fit_joint(df, ["a", "b"], COMPONENTS, blocks, weight_decay=1e-6, max_epochs=60)
    outputs = models.component_outputs(COMPONENTS)
    together = _balanced(both.score(df, outputs), list(outputs.values()))
    single = df
    for c in COMPONENTS:
        single = joint.fit_joint(df, ["a", "b"], [c], blocks, weight_decay=1e-6, max_epochs=60).score(single, outputs)
    assert together < _balanced(single, list(outputs.values())) and together < 0.5
    wide = joint.fit_joint(df.withColumn("g", F.transform("g", lambda p: p * 4000)), ["a"], COMPONENTS, [joint.Block("g", 20_001)], max_epochs=3)
    assert wide.weights.shape == (2, 20_003)
    with pytest.raises(ValueError, match="below zero"):
        joint.fit_joint(df.withColumn("PrimaRC", -F.col("PrimaRC")), ["a"], COMPONENTS)


def test_gradient_of_the_joint_loss(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), [int(k), int(k) + 3], float(p), float(q)) for a, k, p, q in zip(rng.normal(size=60), rng.integers(0, 3, 60), rng.uniform(1, 9, 60), rng.uniform(0, 5, 60))]
    df = spark.createDataFrame(rows, "x0 double, b0 array<long>, y0 double, y1 double").repartition(3)
    objective = joint._Objective(df, 1, [joint.Block("g", 6)], 2, 0.3, 0.01)
    at = rng.normal(size=16) * 0.3
    value, gradient = objective(at)
    for i in (0, 1, 4, 9, 13):
        step = np.zeros(16)
        step[i] = 1e-5
        slope = (objective(at + step)[0] - objective(at - step)[0]) / 2e-5
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def test_grid_and_sampling():
    grid = search.parameter_grid({"b": [1, 2], "a": ["x"], "c": [True, None, 3]})
    assert len(grid) == 6 and grid[0] == {"a": "x", "b": 1, "c": True}
    assert search.parameter_grid(None) == [{}]
    with pytest.raises(ValueError, match="b"):
        search.parameter_grid({"b": 1})
    space = {
        "i": {"type": "int", "low": 300, "high": 900, "step": 50}, "l": {"type": "int", "low": 1, "high": 100, "log": True},
        "f": {"type": "float", "low": 0.7, "high": 1.0, "step": 0.05}, "g": {"type": "float", "low": 1e-8, "high": 1e-3, "log": True},
        "h": {"type": "float", "low": 0.0, "high": 1.0}, "c": {"type": "categorical", "choices": [None, 12]}, "k": ["sqrt", 0.2],
    }
    rng = random.Random(1)
    for _ in range(200):
        drawn = search.sample_parameters(space, rng)
        assert drawn["i"] in range(300, 901, 50) and 1 <= drawn["l"] <= 100 and 1e-8 <= drawn["g"] <= 1e-3
        assert 0.7 <= drawn["f"] <= 1.0 and 0 <= drawn["h"] <= 1 and drawn["c"] in (None, 12) and drawn["k"] in ("sqrt", 0.2)
    with pytest.raises(ValueError, match="is of the kind"):
        search.sample_parameters({"z": {"type": "date"}}, rng)


def test_pair_baselines(rows):
    groups, outputs = ["Pol6TTaCod", "CoberturaLabel"], {"PrimaRC": "m", "PrimaCasco": "c"}
    means = models.PairMeanScorer(rows, groups, COMPONENTS, decimals=2).score(rows, outputs)
    assert {r["m"] for r in means.collect()} == {50.5, 74.5, 98.5}
    lines = models.PairLineScorer(rows.withColumnRenamed("Fea.ture", "f"), groups, COMPONENTS, "f")
    scored = lines.score(rows.withColumnRenamed("Fea.ture", "f"), outputs).collect()
    assert all(r["m"] == pytest.approx(r["PrimaRC"]) and r["c"] == pytest.approx(r["PrimaCasco"]) for r in scored)


def test_leave_fold_out_equals_one_fit_per_fold(rows):
    groups, outputs = ["Pol6TTaCod"], models.component_outputs(COMPONENTS)
    folded = stratified_folds(rows, groups, ["NroPoliza"], 3).cache()
    fast = models.leave_fold_out_means(folded, groups, "Fold", COMPONENTS, outputs, 2)
    slow = search.out_of_fold(folded, lambda part: models.PairMeanScorer(part, groups, COMPONENTS, 2), outputs, 3, 2)
    pick = ["NroPoliza", "`PrimaRC Prediction`", "`PrimaCasco Prediction`"]
    assert sorted(map(tuple, fast.select(*pick).collect())) == sorted(map(tuple, slow.select(*pick).collect()))


def test_search_returns_out_of_fold_scores(spark, rows):
    config = {
        "random_state": 42, "search": {"method": "grid"}, "cv": {"n_splits": 3, "n_jobs": 1},
        "models": [
            {"name": "Small", "type": "extra_trees", "scalers": ["none"], "fixed_params": {"n_estimators": 2}, "param_grid": {"max_depth": [2, 4], "criterion": ["a", "b"]}},
            {"name": "Off", "type": "random_forest", "enabled": False},
        ],
    }
    groups = ["Pol6TTaCod", "CoberturaLabel"]
    best, results = search.search_models(rows, ["Fea.ture"], COMPONENTS, groups, ["NroPoliza"], config)
    assert len(results) == 1 and results[0].trials == 4 and 0 < best.score < 100
    assert search.best_per_model_type(results) == results
    trials = search.trials_table(spark, results)
    assert search.best_trials(trials).first()["trial"] == best.trial
    with pytest.raises(ValueError, match="none that is enabled"):
        search.search_models(rows, ["Fea.ture"], COMPONENTS, groups, ["NroPoliza"], {**config, "models": []})
    with pytest.raises(ValueError, match="search.method is"):
        search.search_models(rows, ["Fea.ture"], COMPONENTS, groups, ["NroPoliza"], {**config, "search": {"method": "x"}})
    with pytest.raises(ValueError, match="cv.shuffle"):
        search.search_models(rows, ["Fea.ture"], COMPONENTS, groups, ["NroPoliza"], {**config, "cv": {"n_splits": 3, "shuffle": False}})
    with pytest.raises(ValueError, match="too few for 9 folds"):
        search.search_models(rows, ["Fea.ture"], COMPONENTS, groups, ["NroPoliza"], {**config, "cv": {"n_splits": 9}})


def test_first_best_wins_ties():
    def result(trial, kind, score):
        return search.SearchResult(trial, kind, kind, "none", "grid", 1, score, {})

    results = [result(0, "a", 2.0), result(1, "b", 1.0), result(2, "b", 1.0), result(3, "a", 1.5)]
    assert search.first_best(results).trial == 1
    assert [r.trial for r in search.best_per_model_type(results)] == [3, 1]


def test_scored_table_hides_encodings(spark):
    df = spark.createDataFrame(
        [(0, "N1", "k7", 64.0, 80.0, "test"), (1, "N2", "k8", 50.0, 0.0, "train")],
        "TariffCoverage_N1__C int, Pol6TTaCod string, NroPoliza string, PrimaRC double, Prima double, `Dataset Split` string",
    )
    scorer = models.ExpressionScorer({"PrimaRC": "60D"}, [])
    scored = models.scored_table(df, scorer, "Prima", "NroPoliza")
    assert scored.columns == ["NroPoliza", "Pol6TTaCod", "PrimaRC", "Prima", "PrimaRC Prediction", "Prediction", "Absolute Percent Error", "Dataset Split"]
    assert [r["Absolute Percent Error"] for r in scored.orderBy("NroPoliza").collect()] == [25.0, None]
    early = models.holdout_scores(scored, "NroPoliza", "Prima").orderBy("NroPoliza").collect()
    assert [tuple(r)[2:] for r in early] == [(60.0, 25.0), (None, None)]
    with pytest.raises(ValueError, match="not assigned"):
        models.scored_table(df.drop("Dataset Split"), scorer, "Prima", "NroPoliza")


def test_tweedie_of_all_components_is_the_library_fit_in_few_jobs(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from premiumscope.operators import smooth

    rows = spark.range(400).selectExpr(
        "CAST(id % 7 AS DOUBLE) AS a", "id * 0.37 % 5 AS b", "3D AS c",
        "exp(0.2D * (id % 7) + id % 3) AS p", "CAST(IF(id % 5 = 0, 0, id % 11) AS DOUBLE) AS q", "4D AS s",
    ).localCheckpoint()
    steps, fixed = [], {"variancePower": 1.5, "regParam": 0.01, "maxIter": 25}
    taken, smooth._solve = smooth._solve, lambda *given: steps.append(1) or taken(*given)
    try:
        found = smooth.fit_tweedie(rows, [F.col(x) for x in "abc"], [F.col(y) for y in "pqs"], **fixed)
    finally:
        smooth._solve = taken
    assembled = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows)
    passes = 0
    for k, label in enumerate("pqs"):
        model = GeneralizedLinearRegression(family="tweedie", linkPower=0.0, featuresCol="x", labelCol=label, **fixed).fit(assembled)
        assert found[k].tolist() == pytest.approx([model.intercept, *model.coefficients], rel=1e-6, abs=1e-8)
        passes += 1 + model.summary.numIterations
    assert len(steps) // 3 < passes  # steps are shared by all targets


def test_tweedie_refuses_missing_features_and_values_below_zero(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (None, 4.0)], "a double, p double")
    with pytest.raises(Exception, match="missing"):
        models.fit_spark_model(rows, ["a"], ["p"], "tweedie")
    scorer = models.fit_spark_model(rows.na.drop(), ["a"], ["p"], "tweedie")
    with pytest.raises(Exception, match="missing"):
        scorer.score(rows, {"p": "q"}).collect()
    with pytest.raises(Exception, match="allows"):
        models.fit_spark_model(rows.na.drop().withColumn("p", -F.col("p")), ["a"], ["p"], "tweedie")


def test_unbagged_forest_learns_from_cells_what_it_learns_from_rows(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("CAST(id % 13 AS DOUBLE) AS u", "CAST(id * 7 % 11 AS DOUBLE) AS w", "CAST(pmod(hash(id), 50) + id % 13 * (id * 7 % 11) AS DOUBLE) AS a",
                                        "CAST(pmod(hash(id, 1), 9) + id % 13 AS DOUBLE) AS b")
    read, fit = [], models._forests
    monkeypatch.setattr(models, "_forests", lambda prepared, *others: read.append(prepared.count()) or fit(prepared, *others))
    names = {"a": "pa", "b": "pb"}
    params = {"n_estimators": 3, "max_depth": 4, "max_features": 0.5}

    def predicted():
        scored = models.fit_spark_model(rows, ["u", "w"], ["a", "b"], "extra_trees", "none", params).score(rows, names)
        assert scored.columns == [*rows.columns, "pa", "pb"]
        return scored, sorted((r["u"], r["w"], r["a"], r["b"], round(r["pa"], 6), round(r["pb"], 6)) for r in scored.collect())

    scored, found = predicted()
    assert read[0] <= 2 * 13 * 11 and "Join" in scored._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(models, "_cell_table", lambda *arguments: None)
    assert predicted()[1] == found and read[1] == 6000
