"""End-to-end runs on files, and plan shape checks."""

import json

import pytest
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.operators import analytics, scale
from premiumscope.operators.models import load_scorer
from premiumscope.plans import build, counterfactual, error_report, train
from premiumscope.sources import readers, writers

SF = "/root/testdata/sf0.001"
CONFIG = {
    "target_column": "Prima",
    "component_target_columns": ["PrimaRC", "PrimaCasco"],
    "identity_column": "NroPoliza",
    "drop_columns": ["NroPoliza", "CoberturaLabel", "Pol6TTaCod"],
    "stratify_columns": ["Pol6TTaCod"],
    "mape_group_columns": {"Tarifa": "Pol6TTaCod"},
    "test_size": 0.2,
    "random_state": 42,
    "search": {"method": "random", "n_trials": 1},
    "cv": {"n_splits": 2, "n_jobs": 2},
    "models": [
        {"name": "Forest", "type": "random_forest", "fixed_params": {"n_estimators": 2}, "sample_space": {"max_depth": [3]}},
    ],
}


@pytest.fixture(scope="module")
def raw(spark):
    keep = ["NroPoliza", "Pol6TTaCod", "Cobertura", "Accesorios", "antig", "TasaCasco", "Marca", "PrimaRC", "PrimaCasco"]
    df = v.portfolio(spark, SF).withColumn("Cobertura", F.expr("Cobertura % 3 + 1")).select(*keep)
    return df.withColumn("Prima", F.round(F.expr("PrimaRC + PrimaCasco"), 2))


def test_csv_to_impact_tables(spark, raw, tmp_path):
    csv, clean_path = str(tmp_path / "raw"), str(tmp_path / "clean.parquet")
    raw.write.option("header", True).csv(csv)
    encoded, result = build.build_dataset(readers.read_raw_portfolio(spark, csv), clean_path, min_pair_count=20)
    clean = readers.read_table(spark, clean_path, trusted=True)
    doubtful = readers.read_table(spark, str(tmp_path / "clean_doubtful.parquet"), trusted=True)
    record = encoded.metadata()
    assert clean.count() + doubtful.count() == record["row_count"] == raw.count()
    assert record["component_target_columns"] == ["PrimaRC", "PrimaCasco"]
    assert doubtful.filter("DoubtfulReason = ''").isEmpty()

    output = str(tmp_path / "runs")
    run = train.train(clean, CONFIG, output, clean_path)
    assert run.summary["train_rows"] + run.summary["test_rows"] == clean.count()
    assert run.summary["stratum_count"] == 3 and run.best.score > 0
    assert {r["target"] for r in run.metrics.collect()} == {"PrimaRC", "PrimaCasco", "final_prima"}
    root = f"{output}/{run.run_id}"
    stored = readers.read_table(spark, f"{root}/scored_dataset.parquet", trusted=True)
    assert stored.columns[0] == "NroPoliza" and not [c for c in stored.columns if c.startswith("TariffCoverage_")]
    assert readers.read_metrics(spark, f"{output}/summary").filter("item = 'random_state'").first()["value"] == "42"

    tables = error_report.error_report(stored, rows=7)
    assert tables["furthest"].count() == 7
    assert tables["summary"].first()["policies"] == run.summary["test_rows"]
    assert tables["histogram"].agg(F.sum("policies")).first()[0] + tables["tails"].first()["outside_view"] == run.summary["test_rows"]
    percent = error_report.error_report(stored, None, "PrimaCasco", analytics.PERCENT, rows=3)
    assert percent["excluded"].first()[0] == stored.filter("PrimaCasco = 0").count()
    signed = error_report.error_report(stored, "", mode=analytics.SIGNED, rows=3)
    assert signed["summary"].first()["policies"] == clean.count()
    with pytest.raises(ValueError, match="no row with a finite"):
        error_report.error_report(stored, "Prima < 0")

    scenario = {
        "selection": {"field": "antig", "op": "gte", "value": 3},
        "feature_changes": [{"field": "TasaCasco", "op": "add", "value": 0.5}],
        "prediction_adjustments": [{"component": "PrimaRC", "op": "increase_pct", "value": 10}],
    }
    path = tmp_path / "scenario.json"
    path.write_text(json.dumps(scenario, indent=1))
    table = counterfactual.run_scenario_from_paths(
        spark, f"{root}/random_forest/model", clean_path, str(path), CONFIG, str(tmp_path / "cf.parquet")
    )
    assert table.count() == clean.filter("antig >= 3").count()
    report = counterfactual.impact_report(table, rows=4, components=["PrimaRC", "PrimaCasco", "PrimaZ"])
    assert report["kpis"].first()["policies"] == table.count() and report["furthest"].count() == 4
    assert [r["component"] for r in report["contributions"].collect()] == ["PrimaRC", "PrimaCasco"]
    assert report["cdf"].agg(F.max("share")).first()[0] == 1.0
    model = load_scorer(spark, f"{root}/random_forest/model")
    with pytest.raises(ValueError, match="component_target_columns"):
        counterfactual.run_scenario(model, clean, scenario, {})
    with pytest.raises(ValueError, match="the scorer predicts"):
        counterfactual.run_scenario(model, clean, scenario, {"component_target_columns": ["PrimaRC"]})
    with pytest.raises(ValueError, match="no pair of scenario premiums"):
        counterfactual.impact_report(clean)


def test_sinks(spark, tmp_path):
    assert writers.doubtful_path("/a/b.c/name.parquet") == "/a/b.c/name_doubtful.parquet"
    assert writers.doubtful_path("/a/b.c/name") == "/a/b.c/name_doubtful"
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", float("nan"))], "NroPoliza string, `Absolute Percent Error` double")
    path = writers.write_table(df, str(tmp_path / "t.parquet"))
    stored = readers.read_table(spark, path, trusted=True)
    assert stored.filter("isnan(`Absolute Percent Error`)").isEmpty()
    assert [r["NroPoliza"] for r in writers.by_error(stored).collect()][:2] == ["c", "a"]
    writers.write_top_rows(stored.orderBy("NroPoliza"), str(tmp_path / "top"), 2)
    assert len(list((tmp_path / "top").glob("part-*.csv"))) == 1
    with pytest.raises(ValueError, match="do not go into one file"):
        writers.write_top_rows(stored, str(tmp_path / "top2"), 10**9)
    for run in ("r1", "r2", "r1"):
        writers.write_metrics(df.limit(1), str(tmp_path / "m"), run)
    logged = readers.read_metrics(spark, str(tmp_path / "m"))
    assert sorted(r["run_id"] for r in logged.collect()) == ["r1", "r2"]


def test_ranked_exports_in_several_files(spark, tmp_path, monkeypatch):
    rows = [(f"k{i:04}", float(i * 37 % 1000) if i % 50 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "NroPoliza string, `Absolute Percent Error` double").repartition(5)
    expected = [k for k, e in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    path = writers.write_sorted_by_error(df, str(tmp_path / "sorted"))
    back = spark.read.option("header", True).csv(path)
    assert [r["NroPoliza"] for r in back.orderBy(F.col(writers.ERROR_RANK).cast("int")).collect()] == expected
    monkeypatch.setattr(writers, "ONE_FILE_ROWS", 100)
    order = [F.col("`Absolute Percent Error`").desc_nulls_last(), F.col("NroPoliza")]
    path = writers.write_top_rows(df, str(tmp_path / "top"), 350, order)
    files = sorted((tmp_path / "top").glob("part-*.csv"))
    assert len(files) > 1
    found = [r["NroPoliza"] for f in files for r in spark.read.option("header", True).csv(str(f)).collect()]
    assert found == expected[:350]


def test_training_run_stores_the_scored_table_once(spark, tmp_path, monkeypatch):
    stored, keep = [], train.materialise
    monkeypatch.setattr(train, "materialise", lambda df, **options: stored.append(df.columns) or keep(df, **options))
    rows = spark.range(120).selectExpr(
        "concat('p', id) AS NroPoliza", "IF(id % 2 = 0, 'R', 'A') AS Pol6TTaCod", "concat('C', id % 3) AS CoberturaLabel",
        "CAST(id % 7 AS DOUBLE) AS antig", "CAST(id % 5 + 1 AS DOUBLE) AS a", "CAST(id % 11 + 2 AS DOUBLE) AS b", "CAST(id % 5 + id % 11 + 3 AS DOUBLE) AS Prima",
    )
    config = {
        "component_target_columns": ["a", "b"], "drop_columns": ["CoberturaLabel", "Pol6TTaCod"], "search": {"method": "grid"}, "cv": {"n_splits": 2},
        "models": [{"name": "J", "type": "joint", "param_grid": {"max_epochs": [1]}}],
    }
    run = train.train(rows, config, str(tmp_path))
    assert not [names for names in stored if "Absolute Percent Error" in names]
    assert len(stored) == 2 and "NroPoliza" not in stored[1]  # the split, and what the test metrics read
    assert run.scored.count() == 120 and str(tmp_path) in run.scored.inputFiles()[0]
    export = spark.read.option("header", True).csv(f"{tmp_path}/{run.run_id}/scored_by_error.csv")
    assert export.count() == 120 and set(run.scored.columns) < set(export.columns)
    assert train.train(rows, config).scored.count() == 120


def test_sorted_export_moves_rows_once_and_stores_none_on_the_way(spark, tmp_path, monkeypatch):
    def refuse(*arguments, **options):
        raise AssertionError("rows are stored on the way")

    monkeypatch.setattr(scale, "materialise", refuse)
    monkeypatch.setattr(scale, "RANGE_ROWS", 100)
    error = ("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 70 = 1 THEN double('NaN') WHEN id % 90 = 2 THEN double('Infinity') "
             "WHEN id % 4 = 0 THEN 5.0D ELSE id * 37 % 1000 END")
    rows = spark.range(1500).selectExpr("IF(id % 3 = 0, NULL, concat('k', id)) AS NroPoliza", f"{error} AS `Absolute Percent Error`").repartition(5)
    path = writers.write_sorted_by_error(rows, str(tmp_path / "sorted"), "parquet")
    back = spark.read.parquet(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int"))
    found = back.orderBy(writers.ERROR_RANK).collect()
    assert [r[writers.ERROR_RANK] for r in found] == list(range(1, 1501))
    order = [F.col("`Absolute Percent Error`").desc_nulls_last(), F.col("NroPoliza")]
    assert [r["NroPoliza"] for r in found] == [r["NroPoliza"] for r in rows.orderBy(*order).collect()]
    assert [r["file"] for r in found] == sorted(r["file"] for r in found) and found[-1]["file"] > found[0]["file"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_engine(spark):
    for df in (v.scored(spark, SF), v.counterfactual(spark, SF), v.folded(spark, SF)):
        plan = plan_of(df)
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    # Labelling a split moves no row of the large side: joins are broadcasts, nothing is exchanged by hash.
    assert "hashpartitioning" not in plan_of(v.split(spark, SF))
    # The only exchange of the clean rows is the one that deals out a small table.
    plan = plan_of(v.clean(spark, SF).select("NroPoliza"))
    assert plan.count("hashpartitioning") == plan.count("REPARTITION_BY_NUM") <= 1


def test_scan_reads_only_needed_columns(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    v.labelled(spark, SF).write.parquet(path)
    rows = readers.read_table(spark, path, trusted=True)
    plan = plan_of(rows.filter("Prima > 10").select("NroPoliza"))
    assert "ReadSchema: struct<NroPoliza:string,Prima:double>" in plan and "GreaterThan(Prima,10.0)" in plan
