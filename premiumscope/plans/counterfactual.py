"""Scenario run from stored inputs, and the impact report tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from premiumscope.operators import analytics
from premiumscope.operators.models import Scorer, load_scorer
from premiumscope.operators.predicate import select_raw_rows
from premiumscope.operators.scale import materialise
from premiumscope.operators.scenario import check_scenario, counterfactual_table
from premiumscope.sources.readers import read_table
from premiumscope.sources.writers import write_table
from premiumscope.spec import FINAL_TARGET_LABEL, IDENTITY_COLUMN, scenario_targets


def load_scenario(spark: SparkSession, path: str) -> dict[str, Any]:
    """A scenario file from any Spark-readable path."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return check_scenario(json.loads(text))


def run_scenario(
    scorer: Scorer, source: DataFrame, scenario: Mapping[str, Any], config: Mapping[str, Any]
) -> DataFrame:
    components = list(config.get("component_target_columns", []))
    if not components:
        raise ValueError("component_target_columns names no component")
    if components != list(scorer.components):
        raise ValueError(f"the scorer predicts {list(scorer.components)}, component_target_columns names {components}")
    total = config.get("target_column", "Prima")
    excluded = [*components, total, *config.get("drop_columns", [IDENTITY_COLUMN])]
    return counterfactual_table(scorer, source, scenario, total, excluded)


def run_scenario_from_paths(
    spark: SparkSession,
    model_path: str,
    dataset_path: str,
    scenario_path: str,
    config: Mapping[str, Any],
    output: str | None = None,
) -> DataFrame:
    """Any saved scorer on a stored dataset. The selection is applied to the columns as they are stored, so it reaches
    the scan; what is left of the scenario then runs on the selected rows."""
    scenario = load_scenario(spark, scenario_path)
    selected = select_raw_rows(read_table(spark, dataset_path, trusted=True), scenario.get("selection"))
    rest = {name: part for name, part in scenario.items() if name != "selection"}
    result = run_scenario(load_scorer(spark, model_path), selected, rest, config)
    if output:
        write_table(result, output)
        return read_table(spark, output, trusted=True)
    return result


def impact_report(
    table: DataFrame,
    target: str = FINAL_TARGET_LABEL,
    measure: str = "_Change",
    percentile: float = 99.5,
    rows: int = 25,
    components: Sequence[str] = ("PrimaRC", "PrimaCasco", "PrimaClausulaAjuste", "PrimaAccesorio"),
    identity: str = IDENTITY_COLUMN,
) -> dict[str, DataFrame]:
    """All tables of the impact report. The measured rows are written once; every table reads that copy."""
    options = scenario_targets(table.columns)
    if target not in options:
        raise ValueError(f"no pair of scenario premiums is called {target!r}; there are {sorted(options)}")
    changes = materialise(analytics.change_rows(table, *options[target]))
    measured = analytics.measured_rows(changes, measure)
    if measured.isEmpty():
        raise ValueError(f"{measure!r} of {target!r} is not finite in any row")
    ranks = analytics.ReportRanks(measured, measure, percentile, symmetric=True)
    view = analytics.central_view(measured, measure, percentile, True, ranks)
    central = measured.filter(view.contains(analytics.col(measure)))
    bins = analytics.bin_count(central, measure).first()["bins"]
    return {
        "kpis": analytics.impact_kpis(changes, measure),
        "excluded": analytics.unmeasured_count(changes, measure),
        "outside_view": analytics.outside_view(measured, measure, view),
        "histogram": analytics.histogram(central, measure, bins, view.lower, view.upper),
        "references": analytics.histogram_references(measured, measure, view, ranks),
        "cdf": analytics.empirical_cdf(measured, measure),
        "furthest": analytics.furthest_from_mean(
            measured,
            measure,
            rows,
            identity,
            {"Signed change": "_Change", "Percentage change (%)": "_PercentChange"},
        ),
        "contributions": analytics.component_contributions(changes, components),
    }
