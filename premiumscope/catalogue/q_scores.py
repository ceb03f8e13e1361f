"""Scored table, regression metrics, error analytics and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.catalogue.registry import query, rounded
from premiumscope.catalogue.sql import COMPONENTS, PREDICTIONS, r, sql
from premiumscope.functions.numeric import col
from premiumscope.operators import analytics, metrics
from premiumscope.operators.models import holdout_scores
from premiumscope.operators.scale import grouped_quantiles, materialise
from premiumscope.operators.split import FOLD, plain_folds
from premiumscope.spec import APE, PREDICTION

EPS = "2.220446049250313e-16"
ACTUAL_SUM = " + ".join(COMPONENTS)
PREDICTED_SUM = " + ".join(PREDICTIONS)
GROUP_ERRORS = f"""
group_errors AS (
  SELECT Pol6TTaCod, CoberturaLabel, avg(abs(({ACTUAL_SUM}) - ({PREDICTED_SUM})) / abs({ACTUAL_SUM}) * 100) AS mape, count(*) AS n
  FROM scored GROUP BY ALL
)"""
ERRORS = f"""
errors AS (
  SELECT *, abs(Prima - Prediction) AS e, Prediction - Prima AS signed,
         CASE WHEN abs(Prima) > {EPS} THEN abs(Prima - Prediction) / abs(Prima) * 100 END AS pct
  FROM scored
)"""


@query(
    "M10_scored_table",
    sql(f"""SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, Prima, {", ".join(PREDICTIONS)}, Prediction,
                   "Absolute Percent Error", "Dataset Split" FROM scored"""),
)
def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["NroPoliza", "Pol6TTaCod", "CoberturaLabel", "Prima", *v.PREDICTIONS, PREDICTION, APE, "Dataset Split"]
    return v.scored(spark, sf_dir).select(*[col(n) for n in names])


@query("A3_mse_mae", sql(f"SELECT {r('avg(pow(Prima - Prediction, 2))', 'mse', 2)}, {r('avg(abs(Prima - Prediction))', 'mae', 4)} FROM scored"))
def mse_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.regression_metrics(v.scored(spark, sf_dir), v.TOTAL, PREDICTION)
    return rounded(table.select("mse", "mae"), 4, mse=2)


@query(
    "A4_mape",
    sql(f"""SELECT {r(f'avg(CASE WHEN abs(PrimaCasco) > {EPS} THEN abs(PrimaCasco - "PrimaCasco Prediction") / abs(PrimaCasco) * 100 END)', 'mape_percent', 3)},
                   count(*) FILTER (abs(PrimaCasco) > {EPS}) AS mape_valid_rows,
                   count(*) FILTER (abs(PrimaCasco) <= {EPS}) AS zero_target_rows FROM scored"""),
)
def mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.regression_metrics(v.scored(spark, sf_dir), "PrimaCasco", "PrimaCasco Prediction")
    return rounded(table.select("mape_percent", "mape_valid_rows", "zero_target_rows"), 3)


def _grouped_sql(column: str) -> str:
    return sql(f"""SELECT {column} AS category, {r('avg("Absolute Percent Error")', 'mape_percent', 4)}, count(*) AS "rows"
                   FROM scored WHERE "Dataset Split" = 'test' AND "Absolute Percent Error" IS NOT NULL GROUP BY {column}""")


@query("A6_mape_by_coverage", _grouped_sql("CoberturaLabel"))
def mape_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = v.by_split(v.scored(spark, sf_dir), "test")
    return rounded(metrics.grouped_mape(test, "CoberturaLabel", v.TOTAL), 4)


@query("A6_mape_by_tariff", _grouped_sql("Pol6TTaCod"))
def mape_by_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = v.by_split(v.scored(spark, sf_dir), "test")
    return rounded(metrics.grouped_mape(test, "Pol6TTaCod", v.TOTAL), 4)


@query(
    "A7_worst_group",
    sql(f"SELECT {r('max(mape)', 'worst_group_mape', 4)}, count(*) AS groups, CAST(0 AS BIGINT) AS zero_totals FROM group_errors", GROUP_ERRORS),
)
def worst_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.worst_group(v.scored(spark, sf_dir), v.SPEC.strata, v.COMPONENTS, v.PREDICTIONS), 4)


@query(
    "A7_group_errors",
    sql(f"""SELECT Pol6TTaCod, CoberturaLabel, {r('mape', 'mape_percent', 4)}, n AS "rows", CAST(0 AS BIGINT) AS zero_totals FROM group_errors""", GROUP_ERRORS),
)
def group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.group_errors(v.scored(spark, sf_dir), v.SPEC.strata, v.COMPONENTS, v.PREDICTIONS), 4)


@query(
    "A8_balanced_mse",
    sql(f"""SELECT {r("0.5 * (" + " + ".join(f'avg(pow({c} - {p}, 2)) / greatest(var_pop({c}), 1.0)' for c, p in zip(COMPONENTS, PREDICTIONS)) + ") / 4 + 0.5 * avg(pow((" + ACTUAL_SUM + ") - (" + PREDICTED_SUM + "), 2)) / greatest(var_pop(" + ACTUAL_SUM + "), 1.0)", 'balanced_mse')} FROM scored"""),
)
def balanced_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.balanced_mse(v.scored(spark, sf_dir), v.COMPONENTS, v.PREDICTIONS, 0.5))


@query("A15_r2", sql(f"SELECT {r('1 - sum(pow(Prima - Prediction, 2)) / (var_pop(Prima) * count(*))', 'r2')} FROM scored"))
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.r_squared(v.scored(spark, sf_dir), v.TOTAL, PREDICTION))


@query(
    "A14_fold_mean_mae",
    sql(
        f"""SELECT {r('avg(mae)', 'mean_mae', 4)}, count(*) AS folds FROM (
              SELECT fold, avg(abs(Prima - Prediction)) AS mae FROM (
                SELECT Prima, Prediction, CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
                       ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
                FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', NroPoliza))) - 1 AS r, count(*) OVER () AS n FROM scored))
              GROUP BY fold)"""
    ),
)
def fold_mean_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain_folds(v.scored(spark, sf_dir), ["NroPoliza"], 5)
    return rounded(metrics.fold_mean_mae(rows, FOLD, v.TOTAL, PREDICTION), 4)


# ---- row measures -----------------------------------------------------------------------------------

def _error_rows(spark: SparkSession, sf_dir: str, mode: str, actual: str = "Prima", predicted: str = PREDICTION) -> DataFrame:
    return analytics.error_rows(v.scored(spark, sf_dir), actual, predicted, mode)


def _stored_errors(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """For reports of several passes: the measured rows are written once."""
    return materialise(_error_rows(spark, sf_dir, mode).select("NroPoliza", "_Actual", "_Predicted", "_Metric"))


@query("G1_absolute_error", sql("SELECT NroPoliza, e AS _Metric FROM errors", ERRORS))
def absolute_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_rows(spark, sf_dir, analytics.ABSOLUTE).select("NroPoliza", "_Metric")


@query(
    "G1_percent_error",
    sql(f"""SELECT NroPoliza, abs(PrimaCasco - "PrimaCasco Prediction") / abs(PrimaCasco) * 100 AS _Metric
            FROM scored WHERE abs(PrimaCasco) > {EPS}"""),
)
def percent_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _error_rows(spark, sf_dir, analytics.PERCENT, "PrimaCasco", "PrimaCasco Prediction")
    return rows.select("NroPoliza", "_Metric")


@query("G1_signed_error", sql("SELECT NroPoliza, signed + 0.0::DOUBLE AS _Metric FROM errors", ERRORS))
def signed_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_rows(spark, sf_dir, analytics.SIGNED).select("NroPoliza", "_Metric")


@query("G1_zero_targets", sql(f"SELECT count(*) FILTER (NOT abs(PrimaCasco) > {EPS}) AS excluded FROM scored"))
def zero_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.zero_target_rows(v.scored(spark, sf_dir), "PrimaCasco")


@query(
    "G2_error_summary",
    sql(f"""SELECT count(*) AS policies, {r('avg(e)', 'mae', 4)}, {r('avg(pct)', 'mape_percent', 4)}, {r('avg(signed)', 'mean_measure', 4)} FROM errors""", ERRORS),
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.error_summary(_error_rows(spark, sf_dir, analytics.SIGNED)), 4)


VIEW_SIGNED = f"""
signed_view AS (SELECT quantile_cont(abs(signed), 0.995) AS cut FROM errors),
signed_central AS (SELECT e.signed AS m FROM errors e, signed_view w WHERE abs(e.signed) <= w.cut)"""
VIEW_ABSOLUTE = """
absolute_view AS (SELECT min(e) AS low, quantile_cont(e, 0.995) AS cut FROM errors),
absolute_central AS (SELECT e.e AS m FROM errors e, absolute_view w WHERE e.e <= w.cut)"""


@query(
    "G3_tail_summary",
    sql(
        f"""SELECT {r('quantile_cont(abs(signed), 0.9)', 'p90', 4)}, {r('quantile_cont(abs(signed), 0.95)', 'p95', 4)},
                   {r('quantile_cont(abs(signed), 0.99)', 'p99', 4)}, {r('max(abs(signed))', 'maximum', 4)},
                   count(*) FILTER (abs(signed) > (SELECT cut FROM signed_view)) AS outside_view FROM errors""",
        ERRORS, VIEW_SIGNED,
    ),
)
def tail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_errors(spark, sf_dir, analytics.SIGNED)
    ranks = analytics.ReportRanks(rows, "_Metric", 99.5, symmetric=True)
    view = analytics.central_view(rows, "_Metric", 99.5, True, ranks)
    return rounded(analytics.tail_summary(rows, "_Metric", True, view, ranks), 4)


@query("A11_quantiles", sql(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, {r(f'quantile_cont(e, {q})', 'value', 4)} FROM errors" for q in (0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0)), ERRORS))
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]
    rows = _stored_errors(spark, sf_dir, analytics.ABSOLUTE)
    found = analytics.exact_quantiles(rows, "_Metric", wanted)
    return rounded(spark.createDataFrame(list(zip(wanted, found)), "q double, value double"), 4)


@query("A11_quantiles_by_brackets", sql(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, {r(f'quantile_cont(e, {q})', 'value', 4)} FROM errors" for q in (0.25, 0.5, 0.99)), ERRORS))
def quantiles_by_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds that columns with more values than a slice take."""
    wanted = [0.25, 0.5, 0.99]
    rows = _stored_errors(spark, sf_dir, analytics.ABSOLUTE)
    found = analytics.exact_quantiles(rows, "_Metric", wanted, slice_rows=200, accuracy=1_000)
    return rounded(spark.createDataFrame(list(zip(wanted, found)), "q double, value double"), 4)


@query(
    "A11_quantiles_per_pair",
    sql(f"""SELECT Pol6TTaCod, CoberturaLabel, {r('quantile_cont(e, 0.5)', 'median', 4)}, {r('quantile_cont(e, 0.9)', 'p90', 4)},
                   {r('max(e)', 'maximum', 4)} FROM errors GROUP BY ALL""", ERRORS),
)
def quantiles_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order statistics of all pairs in one search."""
    rows = materialise(_error_rows(spark, sf_dir, analytics.ABSOLUTE).select("Pol6TTaCod", "CoberturaLabel", "_Metric"))
    found = grouped_quantiles(rows, ["Pol6TTaCod", "CoberturaLabel"], "_Metric", [0.5, 0.9, 1.0])
    values = {name: F.get("values", F.lit(i)) for i, name in enumerate(("median", "p90", "maximum"))}
    return rounded(found.withColumns(values).drop("values"), 4)


@query("A12_mean_median", sql(f"SELECT {r('avg(e)', 'mean', 4)}, {r('quantile_cont(e, 0.5)', 'median', 4)} FROM errors", ERRORS))
def mean_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_errors(spark, sf_dir, analytics.ABSOLUTE)
    (median,) = analytics.exact_quantiles(rows, "_Metric", [0.5])
    return rounded(rows.agg(F.avg("_Metric").alias("mean"), F.lit(median).alias("median")), 4)


@query(
    "G4_central_view_signed",
    sql(f"SELECT {r('-cut', 'lower', 4)}, {r('cut', 'upper', 4)}, (SELECT count(*) FROM signed_central) AS inside FROM signed_view", ERRORS, VIEW_SIGNED),
)
def central_view_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_errors(spark, sf_dir, analytics.SIGNED)
    view = analytics.central_view(rows, "_Metric", 99.5, symmetric=True)
    inside = F.count_if(view.contains(F.col("_Metric"))).alias("inside")
    return rounded(rows.agg(F.lit(view.lower).alias("lower"), F.lit(view.upper).alias("upper"), inside), 4)


@query(
    "G4_central_view_absolute",
    sql(f"SELECT {r('low', 'lower', 4)}, {r('cut', 'upper', 4)}, (SELECT count(*) FROM absolute_central) AS inside FROM absolute_view", ERRORS, VIEW_ABSOLUTE),
)
def central_view_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_errors(spark, sf_dir, analytics.ABSOLUTE)
    view = analytics.central_view(rows, "_Metric", 99.5, symmetric=False)
    inside = F.count_if(view.contains(F.col("_Metric"))).alias("inside")
    return rounded(rows.agg(F.lit(view.lower).alias("lower"), F.lit(view.upper).alias("upper"), inside), 4)


def _bins_sql(source: str) -> str:
    return f"""SELECT CAST(greatest(least(ceil((max(m) - min(m)) / (2 * (quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) / pow(count(*), 1.0 / 3))), 60), 15) AS INTEGER)
               AS bins FROM {source}"""


@query("G5_bin_count", sql(_bins_sql("absolute_central"), ERRORS, VIEW_ABSOLUTE))
def bin_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_errors(spark, sf_dir, analytics.ABSOLUTE)
    view = analytics.central_view(rows, "_Metric", 99.5, symmetric=False)
    return analytics.bin_count(rows.filter(view.contains(F.col("_Metric"))), "_Metric")


def _histogram_sql(source: str, value: str, low: str, high: str, bins: int, window: str) -> str:
    return f"""SELECT b.bin, {r(f'any_value({low}) + b.bin * (any_value({high}) - any_value({low})) / {bins}', 'bin_lower', 3)},
                      count(s.{value}) AS policies
               FROM (SELECT CAST(unnest(range({bins})) AS BIGINT) AS bin) b JOIN {window} w ON TRUE
               LEFT JOIN {source} s ON least(CAST(floor((s.{value} - {low}) / ({high} - {low}) * {bins}) AS BIGINT), {bins - 1}) = b.bin
               GROUP BY b.bin"""


@query(
    "G6_histogram",
    sql(_histogram_sql("absolute_central", "m", "w.low", "w.cut", 30, "absolute_view"), ERRORS, VIEW_ABSOLUTE),
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_errors(spark, sf_dir, analytics.ABSOLUTE)
    view = analytics.central_view(rows, "_Metric", 99.5, symmetric=False)
    central = rows.filter(view.contains(F.col("_Metric")))
    counts = analytics.histogram(central, "_Metric", 30, view.lower, view.upper)
    return rounded(counts.select("bin", "bin_lower", "policies"), 3)


CDF_SQL = f"""SELECT {r('v', 'value', 4)}, cumulative, {r('cumulative / total', 'share')} FROM (
    SELECT v, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS cumulative, CAST(sum(n) OVER () AS DOUBLE) AS total
    FROM (SELECT {{value}} AS v, count(*) AS n FROM {{source}} GROUP BY 1))"""


@query("W3_empirical_cdf", sql(CDF_SQL.format(value="Prima", source="scored")))
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = analytics.empirical_cdf(v.scored(spark, sf_dir), "Prima")
    return rounded(curve.select("value", "cumulative", "share"), 6, value=4)


@query("W3_log_cdf", sql(f"SELECT * FROM ({CDF_SQL.format(value='PrimaCasco', source='scored')}) WHERE value > 0"))
def log_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log axis: only positive values are shown, at their shares of all rows (many components are zero)."""
    curve = analytics.empirical_cdf(v.scored(spark, sf_dir), "PrimaCasco", log_axis=True)
    return rounded(curve.select("value", "cumulative", "share"), 6, value=4)


@query(
    "G7_cdf_references",
    sql(f"SELECT 'P90' AS label, {r('quantile_cont(e, 0.9)', 'value', 4)} FROM errors UNION ALL SELECT 'P95', {r('quantile_cont(e, 0.95)', 'value', 4)} FROM errors", ERRORS),
)
def cdf_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.cdf_references(_stored_errors(spark, sf_dir, analytics.ABSOLUTE), "_Metric"), 4)


@query(
    "G13_histogram_references",
    sql(
        f"""SELECT label, {r('value', 'value', 4)}, {r('greatest(least(value, cut), -cut)', 'plotted', 4)}, abs(value) > cut AS outside_view
            FROM (SELECT 'Mean' AS label, avg(e) AS value FROM errors UNION ALL SELECT 'Median', quantile_cont(e, 0.5) FROM errors)
            JOIN (SELECT quantile_cont(e, 0.4) AS cut FROM errors) ON TRUE""",
        ERRORS,
    ),
)
def histogram_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view narrow enough that the references fall outside and are clipped."""
    rows = _stored_errors(spark, sf_dir, analytics.ABSOLUTE)
    (cut,) = analytics.exact_quantiles(rows, "_Metric", [0.4])
    view = analytics.CentralView(-cut, cut, cut, True)
    return rounded(analytics.histogram_references(rows, "_Metric", view), 4)


@query("W4_deviation", sql(f"SELECT NroPoliza, {r('abs(e - avg(e) OVER ())', '_deviation', 4)} FROM errors", ERRORS))
def deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _error_rows(spark, sf_dir, analytics.ABSOLUTE).select("NroPoliza", "_Metric")
    return rounded(analytics.deviation_from_mean(rows, "_Metric").select("NroPoliza", "_deviation"), 4)


@query(
    "T1_furthest_errors",
    sql(f"""SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, Prima, {r('e', 'Absolute error', 4)}, {r('deviation', 'Deviation from mean', 4)}
            FROM (SELECT *, abs(e - avg(e) OVER ()) AS deviation FROM errors) ORDER BY deviation DESC, NroPoliza LIMIT 50""", ERRORS),
)
def furthest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _error_rows(spark, sf_dir, analytics.ABSOLUTE)
    top = analytics.furthest_from_mean(rows, "_Metric", 50, "NroPoliza", {"Absolute error": "_Metric"})
    names = ["NroPoliza", "Pol6TTaCod", "CoberturaLabel", "Prima", "Absolute error", "Deviation from mean"]
    return rounded(top.select(*[col(n) for n in names]), 4)


@query(
    "M13_holdout_scores",
    sql("""SELECT NroPoliza, Prima, CASE WHEN "Dataset Split" = 'test' THEN Prediction END AS "Prima Prevista",
                  CASE WHEN "Dataset Split" = 'test' AND abs(Prima) > 0 THEN (Prima - Prediction) / Prima * 100 END
                  AS "Porcentaje Error" FROM scored"""),
)
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout_scores(v.scored(spark, sf_dir), v.ID, v.TOTAL)


@query(
    "M14_residuals",
    sql("""SELECT NroPoliza, Prima AS "Real", Prediction AS "Previsto", (Prima - Prediction) / Prima * 100 AS "Porcentaje Error",
                  abs(Prima - Prediction) AS "Error_Absoluto", Prima - Prediction AS "Residual" FROM scored"""),
)
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.residual_table(v.scored(spark, sf_dir), v.ID, v.TOTAL, PREDICTION)


@query(
    "G14_normalised_scatter",
    sql(f"""SELECT NroPoliza, {r('Prima / avg(Prima) OVER ()', 'actual_norm', 5)}, {r('Prediction / avg(Prima) OVER ()', 'predicted_norm', 5)} FROM scored"""),
)
def normalised_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.normalised_scatter(v.scored(spark, sf_dir), v.ID, v.TOTAL, PREDICTION), 5)


@query(
    "G15_error_histograms",
    sql(
        "SELECT 'all' AS histogram, * FROM (" + _histogram_sql("errors", "e", "w.low", "w.high", 30, "whole_range")
        + ") UNION ALL SELECT 'p90', * FROM (" + _histogram_sql("zoomed", "e", "w.low", "w.high", 50, "zoomed_range") + ")",
        ERRORS,
        """whole_range AS (SELECT min(e) AS low, max(e) AS high FROM errors),
           zoomed AS (SELECT e FROM errors WHERE e <= (SELECT quantile_cont(e, 0.9) FROM errors)),
           zoomed_range AS (SELECT min(e) AS low, max(e) AS high FROM zoomed)""",
    ),
)
def error_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = analytics.error_histograms(materialise(v.scored(spark, sf_dir)), v.TOTAL, PREDICTION)
    return rounded(tables.select("histogram", "bin", "bin_lower", "policies"), 3)
