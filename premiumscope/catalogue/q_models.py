"""Scorers, out-of-fold evaluation and model search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.catalogue.registry import query, rounded
from premiumscope.catalogue.sql import COMPONENTS, r, sql
from premiumscope.functions.numeric import col, total_of
from premiumscope.operators import metrics, search, validate
from premiumscope.operators.models import (
    PairLineScorer,
    PairMeanScorer,
    component_outputs,
    fit_spark_model,
    leave_fold_out_means,
    pair_lines,
    scored_table,
    with_total,
)
from premiumscope.operators.scale import checkpoint_root, materialise
from premiumscope.operators.split import FOLD
from premiumscope.plans.train import train_from_path
from premiumscope.sources import readers, writers
from premiumscope.spec import PREDICTION, SPLIT

FEATURES = ["SumaAsegurada", "TasaCasco", "FactorCasco", "antig"]
OUTPUTS = component_outputs(COMPONENTS)


@query(
    "M4_pair_mean_scores",
    sql("SELECT NroPoliza, " + ", ".join(f'"{c} Prediction"' for c in COMPONENTS) + " FROM predicted"),
)
def pair_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.split(spark, sf_dir)
    scorer = PairMeanScorer(v.by_split(rows, "train"), v.SPEC.strata, v.COMPONENTS, v.MONEY)
    return scorer.score(rows, OUTPUTS).select("NroPoliza", *[col(n) for n in OUTPUTS.values()])


LINES_SQL = ", ".join(
    f"{r(f'regr_slope({c}, SumaAsegurada)', f'{c} slope', 5)}, {r(f'regr_intercept({c}, SumaAsegurada)', f'{c} intercept', 3)}"
    for c in COMPONENTS
)


@query("M4_pair_lines", sql(f"SELECT Pol6TTaCod, CoberturaLabel, {LINES_SQL} FROM clean GROUP BY ALL"))
def fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pair_lines(v.clean(spark, sf_dir), v.SPEC.strata, v.COMPONENTS, "SumaAsegurada")
    digits = {f"{c} intercept": 3 for c in v.COMPONENTS}
    return rounded(lines, 5, **digits)


@query(
    "M4_pair_line_scores",
    sql(f"""SELECT Pol6TTaCod, CoberturaLabel, {r('avg(greatest(0, a + b * SumaAsegurada)) + 1e-7', 'mean_prediction', 3)}, count(*) AS "rows"
            FROM clean JOIN (SELECT Pol6TTaCod, CoberturaLabel, regr_intercept(PrimaCasco, SumaAsegurada) AS a,
                                    regr_slope(PrimaCasco, SumaAsegurada) AS b FROM clean GROUP BY ALL) USING (Pol6TTaCod, CoberturaLabel)
            GROUP BY ALL"""),
)
def pair_line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.clean(spark, sf_dir)
    scorer = PairLineScorer(rows, v.SPEC.strata, ["PrimaCasco"], "SumaAsegurada")
    scored = scorer.score(rows, {"PrimaCasco": "p"})
    return rounded(
        scored.groupBy("Pol6TTaCod", "CoberturaLabel").agg(
            (F.avg("p") + 1e-7).alias("mean_prediction"), F.count(F.lit(1)).alias("rows")  # means may lie on a half
        ),
        3,
    )


FOLD_SUMS = f"""
fold_sums AS (
  SELECT stratum, Fold, count(*) AS n, {", ".join(f"sum(CAST({c} AS DECIMAL(20, 2))) AS s_{c}" for c in COMPONENTS)}
  FROM folded GROUP BY stratum, Fold
),
rest AS (
  SELECT stratum, Fold, {", ".join(f'CAST(sum(s_{c}) OVER w - s_{c} AS DOUBLE) / (sum(n) OVER w - n) AS "{c} Prediction"' for c in COMPONENTS)}
  FROM fold_sums WINDOW w AS (PARTITION BY stratum)
),
out_of_fold AS (SELECT f.*, {", ".join(f'"{c} Prediction"' for c in COMPONENTS)} FROM folded f JOIN rest USING (stratum, Fold)),
fold_errors AS (
  SELECT stratum, avg(abs(({" + ".join(COMPONENTS)}) - ({" + ".join(f'"{c} Prediction"' for c in COMPONENTS)})) / abs({" + ".join(COMPONENTS)}) * 100) AS mape
  FROM out_of_fold GROUP BY stratum
)"""


def _out_of_fold_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leave_fold_out_means(v.folded(spark, sf_dir), v.SPEC.strata, FOLD, v.COMPONENTS, OUTPUTS, v.MONEY)


@query(
    "M8_out_of_fold_rows",
    sql("SELECT NroPoliza, Fold, " + " + ".join(f'"{c} Prediction"' for c in COMPONENTS) + " AS Prediction FROM out_of_fold", FOLD_SUMS),
)
def out_of_fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_total(_out_of_fold_means(spark, sf_dir), OUTPUTS, PREDICTION)
    return rows.select("NroPoliza", FOLD, PREDICTION)


@query("M8_out_of_fold_worst_group", sql(f"SELECT {r('max(mape)', 'worst_group_mape', 4)}, count(*) AS groups, CAST(0 AS BIGINT) AS zero_totals FROM fold_errors", FOLD_SUMS))
def out_of_fold_worst_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _out_of_fold_means(spark, sf_dir)
    return rounded(metrics.worst_group(rows, v.SPEC.strata, v.COMPONENTS, v.PREDICTIONS), 4)


@query("U2_fold_union", sql("SELECT Fold, count(*) AS \"rows\", count(DISTINCT NroPoliza) AS policies FROM folded GROUP BY Fold"))
def fold_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit per fold, the held-out parts united: every row comes back exactly once."""
    rows = v.folded(spark, sf_dir)

    def fit(part: DataFrame) -> PairMeanScorer:
        return PairMeanScorer(part, v.SPEC.strata, v.COMPONENTS, v.MONEY)

    united = search.out_of_fold(rows, fit, OUTPUTS, v.FOLDS, workers=v.FOLDS)
    return united.groupBy(FOLD).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("NroPoliza").alias("policies"))


@query("J4_out_of_fold_by_fits", sql("SELECT NroPoliza, Fold, " + " + ".join(f'"{c} Prediction"' for c in COMPONENTS) + " AS Prediction FROM out_of_fold", FOLD_SUMS))
def out_of_fold_by_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.folded(spark, sf_dir)

    def fit(part: DataFrame) -> PairMeanScorer:
        return PairMeanScorer(part, v.SPEC.strata, v.COMPONENTS, v.MONEY)

    united = with_total(search.out_of_fold(rows, fit, OUTPUTS, v.FOLDS), OUTPUTS, PREDICTION)
    return united.select("NroPoliza", FOLD, PREDICTION)


@query(
    "M5_prediction_contract",
    sql("SELECT target, count(*) AS \"rows\", count(*) FILTER (p < 0) AS negative, count(*) FILTER (p IS NULL OR isnan(p) OR isinf(p)) AS not_finite FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS target, \"{c} Prediction\" AS p FROM predicted" for c in COMPONENTS) + ") GROUP BY target"),
)
def prediction_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.scored(spark, sf_dir)
    validate.check_predictions(rows, v.PREDICTIONS)
    report = validate.guard_report(rows, v.PREDICTIONS)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return report.select(
        F.regexp_replace("column", " Prediction$", "").alias("target"),
        total.alias("rows"),
        "negative",
        (F.col("missing") + F.col("not_finite")).alias("not_finite"),
    )


# ---- Spark ML families: results depend on the library's own randomness, so rows are checked only -----

def _family(spark: SparkSession, sf_dir: str, kind: str, scaler: str, params: dict) -> DataFrame:
    rows = v.split(spark, sf_dir).transform(lambda d: v.encode.fill_features(d, v.SPEC.targets))
    if kind != "random_forest":  # its draws follow the files of the rows, which stay as they are
        rows = rows.select(*[col(name) for name in (v.ID, *FEATURES, *v.COMPONENTS, v.TOTAL, SPLIT)])
    rows = materialise(rows)
    scorer = fit_spark_model(v.by_split(rows, "train"), FEATURES, v.COMPONENTS, kind, scaler, params)
    scored = scored_table(rows, scorer, v.TOTAL, v.ID)
    validate.check_predictions(scored, v.PREDICTIONS)
    return scored.select("NroPoliza", *[col(p) for p in v.PREDICTIONS], PREDICTION, "`Absolute Percent Error`", f"`{SPLIT}`")


@query("M1_forest_scores")
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "random_forest", "none", {"n_estimators": 6, "max_depth": 6, "min_samples_leaf": 3, "max_features": 0.7})


@query("M2_flat_forest_scores")
def flat_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "extra_trees", "none", {"n_estimators": 6, "max_depth": 6, "max_features": 0.8})


@query("M3_smooth_scores")
def smooth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "tweedie", "standard", {"weight_decay": 0.01, "max_epochs": 15})


@query("M3_joint_scores")
def joint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components fitted together on the balanced error."""
    return _family(spark, sf_dir, "joint", "robust", {"weight_decay": 1e-6, "max_epochs": 15, "final_weight": 0.5})


RECORD_CONFIG = {
    "target_column": "Prima", "component_target_columns": list(COMPONENTS), "identity_column": "NroPoliza",
    "drop_columns": ["NroPoliza", "CoberturaLabel", "Pol6TTaCod"], "stratify_columns": ["Pol6TTaCod", "CoberturaLabel"],
    "mape_group_columns": {"Cobertura": "CoberturaLabel", "Pol6TTaCod": "Pol6TTaCod"}, "test_size": 0.2, "random_state": 42,
    "search": {"method": "grid"}, "cv": {"n_splits": 3, "n_jobs": 3},
    "models": [
        {"name": "Forest", "type": "random_forest", "fixed_params": {"n_estimators": 2}, "param_grid": {"max_depth": [3]}},
        {"name": "Joint", "type": "joint", "scalers": ["standard"], "param_grid": {"max_epochs": [4]}},
    ],
}


@query(
    "M11_run_record",
    sql("""SELECT 'target_column' AS item, 'Prima' AS value
           UNION ALL SELECT 'random_state', '42' UNION ALL SELECT 'search_method', 'grid'
           UNION ALL SELECT 'stratum_count', CAST((SELECT count(*) FROM strata) AS VARCHAR)
           UNION ALL SELECT 'train_rows', CAST((SELECT count(*) FROM split WHERE "Dataset Split" = 'train') AS VARCHAR)
           UNION ALL SELECT 'test_rows', CAST((SELECT count(*) FROM split WHERE "Dataset Split" = 'test') AS VARCHAR)
           UNION ALL SELECT 'scored rows', CAST((SELECT count(*) FROM clean) AS VARCHAR)
           UNION ALL SELECT 'metric rows', '10' UNION ALL SELECT 'trial rows', '2'
           UNION ALL SELECT 'group rows', CAST(2 * ((SELECT count(DISTINCT Pol6TTaCod) FROM split WHERE "Dataset Split" = 'test')
             + (SELECT count(DISTINCT CoberturaLabel) FROM split WHERE "Dataset Split" = 'test')) AS VARCHAR)"""),
)
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole training run on the stored clean table, judged by what it wrote."""
    root = f"{checkpoint_root(spark)}/catalogue/{uuid.uuid4().hex}"
    columns = [v.ID, *v.SPEC.strata, *FEATURES, *v.COMPONENTS, v.TOTAL]
    writers.write_table(v.numeric_clean(spark, sf_dir).select(*columns), f"{root}/clean.parquet", "zstd")
    run = train_from_path(f"{root}/clean.parquet", RECORD_CONFIG, spark, f"{root}/runs")
    asked = ["target_column", "random_state", "search_method", "stratum_count", "train_rows", "test_rows"]
    record = readers.read_metrics(spark, f"{root}/runs/summary").filter(col("item").isin(asked)).select("item", "value")
    sizes = {
        "scored rows": readers.read_table(spark, f"{root}/runs/{run.run_id}/scored_dataset.parquet"),
        "metric rows": readers.read_metrics(spark, f"{root}/runs/metrics"),
        "trial rows": readers.read_metrics(spark, f"{root}/runs/trials"),
        "group rows": readers.read_metrics(spark, f"{root}/runs/grouped_mape"),
    }
    for item, table in sizes.items():
        counted = table.agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("item", F.lit(item))
        record = record.unionByName(counted)
    return record


SEARCH = {
    "random_state": 42,
    "cv": {"n_splits": 3, "n_jobs": 3},
    "models": [
        {
            "name": "Forest", "type": "random_forest", "scalers": ["none"], "fixed_params": {"max_features": 1.0},
            "param_grid": {"n_estimators": [3], "max_depth": [3, 5]},
            "sample_space": {"n_estimators": {"type": "int", "low": 2, "high": 4}, "max_depth": [3, 5]}, "n_trials": 2,
        },
        {
            "name": "Smooth", "type": "tweedie", "scalers": ["standard"],
            "param_grid": {"weight_decay": [0.01], "max_epochs": [10]},
            "sample_space": {"weight_decay": {"type": "float", "low": 0.001, "high": 0.1, "log": True}}, "n_trials": 1,
        },
    ],
}


def _search(spark: SparkSession, sf_dir: str, method: str) -> list[search.SearchResult]:
    training = v.by_split(v.split(spark, sf_dir), "train").transform(
        lambda d: v.encode.fill_features(d, v.SPEC.targets)
    )
    config = {**SEARCH, "search": {"method": method}}
    _, results = search.search_models(training, FEATURES, v.COMPONENTS, v.SPEC.strata, [v.ID], config)
    return results


@query("M6_grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.trials_table(spark, _search(spark, sf_dir, "grid"))


@query("M7_random_search")
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.trials_table(spark, _search(spark, sf_dir, "random"))


@query("M9_selected_model")
def selected_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = search.trials_table(spark, _search(spark, sf_dir, "grid")).withColumn("all", F.lit(1))
    return search.best_trials(trials, ["all"]).drop("all")


T4_GROUPS = """
candidates AS (
  SELECT 0 AS trial, 'pair' AS model, max(mape) AS score FROM fold_errors
  UNION ALL
  SELECT 1, 'tariff', max(m) FROM (
    SELECT o.stratum, avg(abs((PrimaRC + PrimaCasco + PrimaClausulaAjuste + PrimaAccesorio) - p) / abs(PrimaRC + PrimaCasco + PrimaClausulaAjuste + PrimaAccesorio) * 100) AS m
    FROM folded o JOIN (
      SELECT Pol6TTaCod, Fold, CAST(sum(s) OVER w - s AS DOUBLE) / (sum(n) OVER w - n) AS p FROM (
        SELECT Pol6TTaCod, Fold, count(*) AS n,
               sum(CAST(PrimaRC AS DECIMAL(20, 2)) + CAST(PrimaCasco AS DECIMAL(20, 2)) + CAST(PrimaClausulaAjuste AS DECIMAL(20, 2)) + CAST(PrimaAccesorio AS DECIMAL(20, 2))) AS s
        FROM folded GROUP BY ALL) WINDOW w AS (PARTITION BY Pol6TTaCod)) USING (Pol6TTaCod, Fold)
    GROUP BY o.stratum)
)"""


@query(
    "T4_best_candidate",
    sql(f"SELECT CAST(trial AS INTEGER) AS trial, model, {r('score', 'cv_worst_pair_mape_percent', 3)} FROM candidates ORDER BY score, trial LIMIT 1", FOLD_SUMS, T4_GROUPS),
)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair means against tariff means, both scored out of fold by the worst pair; the lower one wins."""
    rows = materialise(v.folded(spark, sf_dir))
    results = []
    for trial, (name, groups) in enumerate([("pair", v.SPEC.strata), ("tariff", [v.SPEC.tariff])]):
        predicted = leave_fold_out_means(rows, groups, FOLD, v.COMPONENTS, OUTPUTS, v.MONEY)
        score = metrics.worst_group_mape(predicted, v.SPEC.strata, v.COMPONENTS, v.PREDICTIONS)
        results.append(search.SearchResult(trial, name, "mean", "none", "grid", 1, score, {}))
    trials = search.trials_table(spark, results).withColumn("all", F.lit(1))
    best = search.best_trials(trials, ["all"]).select("trial", "model", "cv_worst_pair_mape_percent")
    return rounded(best, 3)


@query(
    "M11_run_counts",
    sql("""SELECT (SELECT count(*) FROM strata) AS stratum_count, count(*) FILTER ("Dataset Split" = 'train') AS train_rows,
                  count(*) FILTER ("Dataset Split" = 'test') AS test_rows FROM split"""),
)
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.split(spark, sf_dir)
    return rows.agg(
        F.count_distinct(F.concat_ws("\x1f", *v.SPEC.strata)).alias("stratum_count"),
        F.count_if(col(SPLIT) == "train").alias("train_rows"),
        F.count_if(col(SPLIT) == "test").alias("test_rows"),
    )


@query(
    "J5_every_row_labelled",
    sql("""SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS unlabelled FROM clean"""),
)
def every_row_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.split(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_if(col(SPLIT).isNull()).alias("unlabelled"))


@query(
    "J3_targets_beside_features",
    sql(f"SELECT NroPoliza, SumaAsegurada, {r(' + '.join(COMPONENTS), 'component_sum', 2)}, Pol6TTaCod || chr(31) || CoberturaLabel AS stratum FROM clean"),
)
def targets_beside_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, targets and stratum of a row are columns of one row; nothing is aligned by a join."""
    rows = v.clean(spark, sf_dir)
    total = total_of([col(c) for c in v.COMPONENTS]).alias("component_sum")
    stratum = F.concat_ws("\x1f", *v.SPEC.strata).alias("stratum")
    return rows.select("NroPoliza", "SumaAsegurada", F.round(total, 2).alias("component_sum"), stratum)
