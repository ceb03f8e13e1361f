"""Counterfactual scenarios and impact analytics."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.catalogue.registry import query, rounded
from premiumscope.catalogue.sql import COMPONENTS, r, sql
from premiumscope.functions.numeric import col
from premiumscope.operators import analytics, scenario
from premiumscope.operators.models import PairMeanScorer, load_scorer, model_features, save_scorer
from premiumscope.operators.predicate import portfolio_filter, select_rows
from premiumscope.operators.scale import checkpoint_root
from premiumscope.plans.counterfactual import run_scenario_from_paths

BOTH = [f"{c}_{kind}" for c in (*COMPONENTS, "Prima") for kind in ("Baseline", "Counterfactual")]


@query("C2_selected_rows", sql("SELECT NroPoliza, antig, Pol6TTaCod FROM selected"))
def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_rows(v.clean(spark, sf_dir), v.SCENARIO["selection"]).select("NroPoliza", "antig", "Pol6TTaCod")


CHANGES = [
    {"field": "TasaCasco", "op": "increase_pct", "value": 15},
    {"field": "TasaCasco", "op": "add", "value": "0.5"},
    {"field": "SumaAsegurada", "op": "decrease_pct", "value": 20},
    {"field": "FactorCasco", "op": "set", "value": 0.1},
    {"field": "TasaCasco", "op": "multiply", "value": 2},
]


@query(
    "C3_value_changes",
    sql(f"""SELECT NroPoliza, {r('(TasaCasco * 1.15::DOUBLE + 0.5::DOUBLE) * 2::DOUBLE', 'TasaCasco')},
                   {r('SumaAsegurada * 0.8::DOUBLE', 'SumaAsegurada')}, 0.1::DOUBLE AS FactorCasco FROM portfolio"""),
)
def value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "TasaCasco", "SumaAsegurada", "FactorCasco")
    return rounded(scenario.apply_changes(df, CHANGES))


@query("C4_changed_features", sql(f"SELECT NroPoliza, TasaCasco, {r('TasaCasco_Counterfactual', 'TasaCasco_Counterfactual')} FROM selected"))
def changed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.counterfactual(spark, sf_dir).select("NroPoliza", "TasaCasco", "TasaCasco_Counterfactual"))


@query(
    "C5_baseline_and_counterfactual",
    sql(f"""SELECT NroPoliza, {r('PrimaCasco_Baseline', 'PrimaCasco_Baseline')}, {r('PrimaCasco_Counterfactual', 'PrimaCasco_Counterfactual')},
                   {r('SumaAsegurada * 0.04::DOUBLE', 'PrimaRC_Counterfactual')} FROM priced"""),
)
def baseline_and_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scorings without component adjustments."""
    plain = {**v.SCENARIO, "prediction_adjustments": []}
    table = scenario.counterfactual_table(
        v.formula_scorer(), v.numeric_clean(spark, sf_dir), plain, v.TOTAL, [*v.SPEC.targets, v.ID]
    )
    return rounded(table.select("NroPoliza", "PrimaCasco_Baseline", "PrimaCasco_Counterfactual", "PrimaRC_Counterfactual"))


@query(
    "C6_adjusted_component",
    sql(f"SELECT NroPoliza, {r('PrimaRC_Baseline', 'PrimaRC_Baseline')}, {r('PrimaRC_Counterfactual', 'PrimaRC_Counterfactual')} FROM priced"),
)
def adjusted_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.counterfactual(spark, sf_dir).select("NroPoliza", "PrimaRC_Baseline", "PrimaRC_Counterfactual"))


@query(
    "C7_counterfactual_rows",
    sql(f"""SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, antig, TasaCasco, {r('TasaCasco_Counterfactual', 'TasaCasco_Counterfactual')},
                   {", ".join(r(n, n) for n in BOTH)} FROM counterfactual"""),
)
def counterfactual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["NroPoliza", "Pol6TTaCod", "CoberturaLabel", "antig", "TasaCasco", "TasaCasco_Counterfactual", *BOTH]
    return rounded(v.counterfactual(spark, sf_dir).select(*names))


PAIR_PRICED = ", ".join(
    f"""CAST(sum(CAST({c} AS DECIMAL(20, 2))) AS DOUBLE) / count({c}) AS "{c}_Mean\"""" for c in COMPONENTS
)
PAIR_PREMIUMS = {
    **{f"{c}_{kind}": f'm."{c}_Mean"' + (" * 1.1::DOUBLE" if (c, kind) == ("PrimaRC", "Counterfactual") else "")
       for c in COMPONENTS for kind in ("Baseline", "Counterfactual")}
}
PAIR_TOTALS = {f"Prima_{kind}": " + ".join(PAIR_PREMIUMS[f"{c}_{kind}"] for c in COMPONENTS) for kind in ("Baseline", "Counterfactual")}


@query(
    "C8_scenario_from_paths",
    sql(
        f"""SELECT 'formula' AS kind, NroPoliza, {r('TasaCasco_Counterfactual', 'TasaCasco_Counterfactual')}, {", ".join(r(n, n) for n in BOTH)}
            FROM counterfactual WHERE TasaCasco >= 0.02
            UNION ALL
            SELECT 'pair means', NroPoliza, NULL,
                   {", ".join(r({**PAIR_PREMIUMS, **PAIR_TOTALS}[n], n) for n in BOTH)}
            FROM selected JOIN (SELECT Pol6TTaCod, CoberturaLabel, {PAIR_PRICED} FROM clean GROUP BY ALL) m USING (Pol6TTaCod, CoberturaLabel)
            WHERE TasaCasco >= 0.02""",
    ),
)
def scenario_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved scorers of two kinds, a stored dataset with NaN in it and scenario files to stored tables. Pair means read
    no feature that could be changed."""
    root = f"{checkpoint_root(spark)}/catalogue/{uuid.uuid4().hex}"
    rows = v.numeric_clean(spark, sf_dir).withColumn("unused", F.when(F.col("antig") > 3, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    rows.write.parquet(f"{root}/clean.parquet")
    selection = {"all": [v.SCENARIO["selection"], {"field": "TasaCasco", "op": "gte", "value": 0.02}]}
    config = {"component_target_columns": list(COMPONENTS), "target_column": "Prima"}
    scorers = {"formula": v.formula_scorer(), "pair means": PairMeanScorer(v.clean(spark, sf_dir), v.SPEC.strata, v.COMPONENTS, v.MONEY)}
    tables = []
    for kind, scorer in scorers.items():
        model, output = f"{root}/{kind.replace(' ', '_')}", f"{root}/{kind.replace(' ', '_')}.parquet"
        save_scorer(scorer, model)
        changes = v.SCENARIO["feature_changes"] if scorer.features else []
        text = json.dumps({**v.SCENARIO, "selection": selection, "feature_changes": changes})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{model}/scenario")
        table = run_scenario_from_paths(spark, model, f"{root}/clean.parquet", f"{model}/scenario", config, output)
        if not changes:
            table = table.withColumn("TasaCasco_Counterfactual", F.lit(None).cast("double"))
        tables.append(rounded(table.select(F.lit(kind).alias("kind"), "NroPoliza", "TasaCasco_Counterfactual", *BOTH)))
    return tables[0].unionByName(tables[1])


REFUSED_SCENARIOS = {
    "no object": [],
    "changes not a list": {"feature_changes": {}},
    "adjustments not a list": {"prediction_adjustments": "x"},
    "selection not an object": {"selection": []},
    "unknown column": {"feature_changes": [{"field": "nope", "op": "set", "value": 1}]},
    "unknown operation": {"feature_changes": [{"field": "TasaCasco", "op": "power", "value": 2}]},
    "no number": {"feature_changes": [{"field": "TasaCasco", "op": "add", "value": "much"}]},
    "unknown component": {"prediction_adjustments": [{"component": "PrimaZ", "op": "add", "value": 1}]},
    "no rows": {"selection": {"field": "antig", "op": "gt", "value": 1e6}},
    "negative premium": {"prediction_adjustments": [{"component": "PrimaRC", "op": "add", "value": -1e9}]},
    "fine": {},
}


@query(
    "C1_refused_scenarios",
    "SELECT name, name <> 'fine' AS refused FROM (SELECT unnest([" + ", ".join(f"'{name}'" for name in REFUSED_SCENARIOS) + "]) AS name)",
)
def refused_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scenarios are turned down when they are run on the clean table."""
    rows = v.numeric_clean(spark, sf_dir)

    def refused(case: object) -> bool:
        try:
            scenario.counterfactual_table(v.formula_scorer(), rows, case, v.TOTAL, [*v.SPEC.targets, v.ID])
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(name, refused(case)) for name, case in REFUSED_SCENARIOS.items()], "name string, refused boolean")


# ---- impact analytics -------------------------------------------------------------------------------

def _changes(spark: SparkSession, sf_dir: str, component: str = "Prima") -> DataFrame:
    table = v.counterfactual(spark, sf_dir)
    return analytics.change_rows(table, f"{component}_Baseline", f"{component}_Counterfactual")


@query("G9_change_rows", sql(f"SELECT NroPoliza, {r('change', '_Change')}, {r('percent', '_PercentChange')} FROM changes"))
def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_changes(spark, sf_dir).select("NroPoliza", "_Change", "_PercentChange"))


CASCO = """
casco AS (
  SELECT *, PrimaCasco_Counterfactual - PrimaCasco_Baseline AS cc,
         CASE WHEN abs(PrimaCasco_Baseline) > 2.220446049250313e-16
              THEN (PrimaCasco_Counterfactual - PrimaCasco_Baseline) / PrimaCasco_Baseline * 100 END AS cp
  FROM counterfactual
)"""


@query("G10_percent_rows", sql(f"SELECT NroPoliza, {r('cp', '_PercentChange')} FROM casco WHERE cp IS NOT NULL", CASCO))
def percent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.measured_rows(_changes(spark, sf_dir, "PrimaCasco"), "_PercentChange")
    return rounded(rows.select("NroPoliza", "_PercentChange"))


@query("G10_excluded", sql("SELECT count(*) FILTER (cp IS NULL) AS excluded FROM casco", CASCO))
def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.unmeasured_count(_changes(spark, sf_dir, "PrimaCasco"), "_PercentChange")


def _kpi_sql(base: str, scen: str, change: str, percent: str, measure: str) -> str:
    return f"""SELECT count(*) AS policies, {r(f'sum({base})', 'baseline_total', 2)}, {r(f'sum({scen})', 'counterfactual_total', 2)},
      {r(f'sum({scen}) - sum({base})', 'portfolio_change', 2)}, {r(f'(sum({scen}) - sum({base})) / sum({base}) * 100', 'portfolio_percent', 4)},
      {r(f'avg({change})', 'mean_change', 4)}, {r(f'avg({percent})', 'mean_percent_change', 4)}, {r(f'stddev_pop({measure})', 'measure_std', 4)},
      {r(f'avg(CASE WHEN {change} > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'share_increased', 6)}"""


TOTAL_KPIS = _kpi_sql("Prima_Baseline", "Prima_Counterfactual", "change", "percent", "change")
CASCO_KPIS = _kpi_sql("PrimaCasco_Baseline", "PrimaCasco_Counterfactual", "cc", "cp", "cc")
MONEY_DIGITS = {"baseline_total": 2, "counterfactual_total": 2, "portfolio_change": 2, "share_increased": 6}


@query("G11_impact_kpis", sql(f"{TOTAL_KPIS} FROM changes"))
def impact_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.impact_kpis(_changes(spark, sf_dir)), 4, **MONEY_DIGITS)


@query("A9_component_kpis", sql(f"{CASCO_KPIS} FROM casco", CASCO))
def component_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.impact_kpis(_changes(spark, sf_dir, "PrimaCasco")), 4, **MONEY_DIGITS)


@query(
    "A10_component_contributions",
    sql(" UNION ALL ".join(f"SELECT '{c}' AS component, {r(f'avg({c}_Counterfactual - {c}_Baseline)', 'mean_change', 4)} FROM counterfactual" for c in COMPONENTS)),
)
def component_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.component_contributions(v.counterfactual(spark, sf_dir), COMPONENTS), 4)


@query(
    "G12_contributions_by_tariff_choice",
    sql(" UNION ALL ".join(f"SELECT '{c}' AS component, {r(f'avg({c}_Counterfactual - {c}_Baseline)', 'mean_change', 4)} FROM counterfactual WHERE antig BETWEEN 3 AND 4" for c in COMPONENTS)),
)
def filtered_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = portfolio_filter(v.counterfactual(spark, sf_dir), ["R"], (), (3, 4))
    return rounded(analytics.component_contributions(kept, COMPONENTS), 4)


@query(
    "G8_furthest_changes",
    sql(f"""SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, {r('Prima_Baseline', 'Prima_Baseline')}, {r('change', 'Signed change')},
                   {r('percent', 'Percentage change (%)')}, {r('deviation', 'Deviation from mean', 4)}
            FROM (SELECT *, abs(change - avg(change) OVER ()) AS deviation FROM changes) ORDER BY deviation DESC, NroPoliza LIMIT 25"""),
)
def furthest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"Signed change": "_Change", "Percentage change (%)": "_PercentChange"}
    top = analytics.furthest_from_mean(_changes(spark, sf_dir), "_Change", 25, v.ID, extra)
    names = ["NroPoliza", "Pol6TTaCod", "CoberturaLabel", "Prima_Baseline", "Signed change", "Percentage change (%)", "Deviation from mean"]
    return rounded(top.select(*[col(n) for n in names]), 6, **{"Deviation from mean": 4})


@query(
    "G7_change_cdf",
    sql(f"""SELECT {r('v', 'value')}, cumulative, {r('cumulative / total', 'share')} FROM (
              SELECT v, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS cumulative, CAST(sum(n) OVER () AS DOUBLE) AS total
              FROM (SELECT change AS v, count(*) AS n FROM changes GROUP BY 1))"""),
)
def change_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = analytics.empirical_cdf(_changes(spark, sf_dir), "_Change")
    return rounded(curve.select("value", "cumulative", "share"))


@query(
    "M12_model_features",
    sql("SELECT name, CAST(count(*) AS BIGINT) AS \"rows\" FROM (SELECT unnest(['SumaAsegurada', 'TasaCasco', 'FactorCasco', 'antig']) AS name FROM clean) GROUP BY name"),
)
def used_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scorer reads, asked of it after it was saved and loaded."""
    rows = v.clean(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/catalogue/{uuid.uuid4().hex}/model"
    save_scorer(v.formula_scorer(), path)
    names = F.array(*[F.lit(n) for n in model_features(load_scorer(spark, path), rows.columns, [])])
    return rows.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
