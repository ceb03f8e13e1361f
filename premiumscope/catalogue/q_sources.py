"""Scans and sinks: every sink is checked by reading back what it wrote."""

from __future__ import annotations

import operator
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.catalogue.registry import query, rounded
from premiumscope.catalogue.sql import r, sql
from premiumscope.functions.numeric import col
from premiumscope.operators import analytics, encode, metrics
from premiumscope.operators.joint import fit_joint
from premiumscope.operators.models import PairLineScorer, PairMeanScorer, fit_spark_model, load_scorer, save_scorer
from premiumscope.operators.scale import checkpoint_root, materialise
from premiumscope.sources import readers, writers
from premiumscope.spec import APE, encoding_columns


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/catalogue/{uuid.uuid4().hex}/{name}"


@query("S1_parquet_scan", "SELECT l_orderkey, l_partkey, l_returnflag, l_tax FROM lineitem")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.read_table(spark, f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_partkey", "l_returnflag", "l_tax")


@query(
    "S2_raw_portfolio",
    sql("""SELECT NroPoliza, Pol6TTaCod, CAST(Cobertura AS VARCHAR) AS Cobertura, Accesorios, Marca,
                  CAST(antig AS VARCHAR) AS antig FROM portfolio"""),
)
def raw_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "raw_csv")
    chosen = ["NroPoliza", "Pol6TTaCod", "Cobertura", "Accesorios", "Marca", "antig"]
    v.portfolio(spark, sf_dir).select(*chosen).write.option("header", True).csv(path)
    return readers.read_raw_portfolio(spark, path)


@query("S3_clean_parquet", sql("SELECT NroPoliza, CoberturaLabel, PrimaRC, Prima FROM clean"))
def clean_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.clean(spark, sf_dir).select("NroPoliza", "CoberturaLabel", "PrimaRC", "Prima")
    return readers.read_table(spark, writers.write_table(rows, _path(spark, "clean.parquet")), trusted=True)


@query(
    "S4_clean_and_doubtful",
    sql("""SELECT 'clean' AS "table", NroPoliza, '' AS DoubtfulReason FROM clean
           UNION ALL
           SELECT 'doubtful', NroPoliza, concat_ws('; ',
             CASE WHEN NOT sum_ok THEN 'Prima component sum mismatch' END,
             CASE WHEN NOT nonneg THEN 'Negative Prima value' END,
             CASE WHEN NOT has_coverage THEN 'Missing Cobertura' END,
             CASE WHEN has_coverage AND pair_count < 20 THEN 'Rare Pol6TTaCod/Cobertura pair (<20 rows)' END)
           FROM counted WHERE NOT (sum_ok AND nonneg AND has_coverage AND pair_count >= 20)"""),
)
def clean_and_doubtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean_path, doubtful_path = writers.write_clean_and_doubtful(
        v.triaged(spark, sf_dir), _path(spark, "portfolio.parquet")
    )
    clean = readers.read_table(spark, clean_path, trusted=True)
    doubtful = readers.read_table(spark, doubtful_path, trusted=True)
    return clean.select(F.lit("clean").alias("table"), "NroPoliza", F.lit("").alias("DoubtfulReason")).unionByName(
        doubtful.select(F.lit("doubtful").alias("table"), "NroPoliza", "DoubtfulReason")
    )


@query(
    "S5_scored_parquet",
    sql("""SELECT NroPoliza, Prediction, "Absolute Percent Error", "Dataset Split" FROM scored"""),
)
def scored_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_table(v.scored(spark, sf_dir), _path(spark, "scored_dataset.parquet"))
    back = readers.read_table(spark, path, trusted=True)
    return back.select("NroPoliza", "Prediction", APE, "Dataset Split")


@query(
    "S6_sorted_by_error",
    sql("""SELECT NroPoliza, "Dataset Split", row_number() OVER (ORDER BY "Absolute Percent Error" DESC NULLS LAST, NroPoliza)
           AS "Error rank", true AS in_order FROM scored"""),
)
def sorted_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export is read back with the file of every row: places must rise from file to file."""
    path = writers.write_sorted_by_error(v.scored(spark, sf_dir), _path(spark, "scored_by_error"), "parquet")
    back = spark.read.parquet(path).withColumn("_file", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int"))
    rank = col(writers.ERROR_RANK)
    ends = back.groupBy("_file").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    earlier = F.coalesce(F.max("last").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checked = ends.select("_file", (F.col("first") > earlier).alias("in_order"))  # one row per file
    return back.join(F.broadcast(checked), "_file").select("NroPoliza", "Dataset Split", rank.cast("long").alias(writers.ERROR_RANK), "in_order")


METRIC_ROWS = """
metric_rows AS (
  SELECT 'PrimaRC' AS target, PrimaRC AS a, "PrimaRC Prediction" AS p FROM scored WHERE "Dataset Split" = 'test'
  UNION ALL SELECT 'PrimaCasco', PrimaCasco, "PrimaCasco Prediction" FROM scored WHERE "Dataset Split" = 'test'
  UNION ALL SELECT 'PrimaClausulaAjuste', PrimaClausulaAjuste, "PrimaClausulaAjuste Prediction" FROM scored
    WHERE "Dataset Split" = 'test'
  UNION ALL SELECT 'PrimaAccesorio', PrimaAccesorio, "PrimaAccesorio Prediction" FROM scored WHERE "Dataset Split" = 'test'
  UNION ALL SELECT 'final_prima', Prima, Prediction FROM scored WHERE "Dataset Split" = 'test'
)"""
METRIC_COLUMNS = f"""{r('avg(pow(a - p, 2))', 'mse', 2)}, {r('avg(abs(a - p))', 'mae', 4)},
  {r('avg(CASE WHEN abs(a) > 2.220446049250313e-16 THEN abs(a - p) / abs(a) * 100 END)', 'mape_percent', 4)},
  count(*) FILTER (abs(a) > 2.220446049250313e-16) AS mape_valid_rows,
  count(*) FILTER (abs(a) <= 2.220446049250313e-16) AS zero_target_rows"""


def _test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = v.by_split(v.scored(spark, sf_dir), "test")
    table = metrics.multioutput_metrics(test, v.COMPONENTS, v.PREDICTIONS, v.TOTAL)
    return rounded(table, 4, mse=2)


@query("S7_metrics_log", sql(f"SELECT * FROM (SELECT target, {METRIC_COLUMNS} FROM metric_rows GROUP BY target), (SELECT unnest(['r1', 'r2']) AS run_id)", METRIC_ROWS))
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs are logged and the first of them once more: it is replaced, the other one stays."""
    rows, path = _test_metrics(spark, sf_dir), _path(spark, "metrics")
    for run_id in ("r1", "r2", "r1"):
        writers.write_metrics(rows, path, run_id)
    return readers.read_metrics(spark, path)


@query("A5_component_metrics", sql(f"SELECT target, {METRIC_COLUMNS} FROM metric_rows GROUP BY target", METRIC_ROWS))
def component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_metrics(spark, sf_dir)


@query(
    "S8_counterfactual_parquet",
    sql(f"SELECT NroPoliza, {r('Prima_Baseline', 'Prima_Baseline')}, {r('Prima_Counterfactual', 'Prima_Counterfactual')} FROM counterfactual"),
)
def counterfactual_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_table(v.counterfactual(spark, sf_dir), _path(spark, "counterfactual.parquet"))
    back = readers.read_table(spark, path, trusted=True)
    return rounded(back.select("NroPoliza", "Prima_Baseline", "Prima_Counterfactual"))


@query(
    "S9_top_rows_csv",
    sql("""SELECT NroPoliza, CAST(round(deviation, 4) AS DOUBLE) AS "Deviation from mean" FROM (
             SELECT NroPoliza, abs(abs(Prima - Prediction) - avg(abs(Prima - Prediction)) OVER ()) AS deviation FROM scored)
           ORDER BY deviation DESC, NroPoliza LIMIT 25"""),
)
def top_rows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = analytics.error_rows(v.scored(spark, sf_dir), v.TOTAL, "Prediction")
    top = analytics.furthest_from_mean(errors, "_Metric", 25, v.ID)
    path = writers.write_top_rows(top, _path(spark, "furthest.csv"), 25)
    back = spark.read.option("header", True).csv(path)
    return rounded(back.select("NroPoliza", col("Deviation from mean").cast("double").alias("Deviation from mean")), 4)


FOREST_FEATURES = ["SumaAsegurada", "TasaCasco", "FactorCasco", "antig"]


@query(
    "S10_saved_model",
    sql("""SELECT kind, (SELECT count(*) FROM clean) AS "rows", CAST(0 AS BIGINT) AS differing
           FROM (SELECT unnest(['formula', 'joint', 'pair lines', 'pair means', 'pipeline']) AS kind)"""),
)
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer of every kind gives the same predictions of all components after it was saved and loaded."""
    rows = materialise(v.numeric_clean(spark, sf_dir))
    fitted = {
        "formula": v.formula_scorer(),
        "joint": fit_joint(rows, FOREST_FEATURES, v.COMPONENTS, max_epochs=3),
        "pair lines": PairLineScorer(rows, v.SPEC.strata, v.COMPONENTS, "SumaAsegurada"),
        "pair means": PairMeanScorer(rows, v.SPEC.strata, v.COMPONENTS, v.MONEY),
        "pipeline": fit_spark_model(rows, FOREST_FEATURES, v.COMPONENTS, "random_forest", params={"n_estimators": 3, "max_depth": 4}),
    }
    tables = []
    for kind, scorer in fitted.items():
        path = _path(spark, "model")
        save_scorer(scorer, path)
        first = scorer.score(rows, {c: f"before_{i}" for i, c in enumerate(v.COMPONENTS)})
        both = load_scorer(spark, path).score(first, {c: f"after_{i}" for i, c in enumerate(v.COMPONENTS)})
        differs = reduce(operator.or_, [~col(f"before_{i}").eqNullSafe(col(f"after_{i}")) for i in range(len(v.COMPONENTS))])
        tables.append(both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(differs).alias("differing")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, tables).select("kind", "rows", "differing")


@query(
    "P12_without_pair_columns",
    sql("SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, Prima FROM labelled"),
)
def without_pair_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.labelled(spark, sf_dir).select("NroPoliza", "Pol6TTaCod", "CoberturaLabel", "Prima")
    encoded = encode.pair_one_hot(rows, encode.fit_pairs(rows))
    return encoded.drop(*encoding_columns(encoded.columns))


@query("P19_preview", sql("SELECT NroPoliza, Prima FROM clean ORDER BY NroPoliza LIMIT 5"))
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.preview(v.clean(spark, sf_dir).select("NroPoliza", "Prima").orderBy("NroPoliza"))


