"""Row selection: one query per predicate form, over a nullable, a text and an integer column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.catalogue.registry import query
from premiumscope.catalogue.sql import sql
from premiumscope.operators import predicate

FACTOR = "FactorCasco"

# name -> (expression, SQL condition with two-valued treatment of missing cells)
SELECTIONS: dict[str, tuple[dict[str, Any] | None, str]] = {
    "F6_all_rows": (None, "TRUE"),
    "F7_all": (
        {"all": [{"field": "antig", "op": "between", "lower": 2, "upper": 5}, {"field": "Pol6TTaCod", "op": "eq", "value": "R"}]},
        "antig BETWEEN 2 AND 5 AND Pol6TTaCod = 'R'",
    ),
    "F7_any": (
        {"any": [{"field": "antig", "op": "gt", "value": 5}, {"field": FACTOR, "op": "is_null"}]},
        "antig > 5 OR FactorCasco IS NULL",
    ),
    "F7_not": (
        {"not": {"field": FACTOR, "op": "gt", "value": 0.05}},
        "FactorCasco IS NULL OR FactorCasco <= 0.05::DOUBLE",
    ),
    "F7_nested": (
        {
            "any": [
                {"not": {"all": [{"field": FACTOR, "op": "lte", "value": 0.03}, {"field": "antig", "op": "ne", "value": 3}]}},
                {"field": "Marca", "op": "in", "values": ["Brand#1", "Brand#2"]},
            ]
        },
        "NOT (coalesce(FactorCasco <= 0.03::DOUBLE, FALSE) AND antig <> 3) OR Marca IN ('Brand#1', 'Brand#2')",
    ),
    "F8_eq": ({"field": FACTOR, "op": "eq", "value": 0.04}, "coalesce(FactorCasco = 0.04::DOUBLE, FALSE)"),
    "F8_ne": ({"field": FACTOR, "op": "ne", "value": 0.04}, "FactorCasco IS DISTINCT FROM 0.04::DOUBLE"),
    "F8_gt": ({"field": FACTOR, "op": "gt", "value": 0.04}, "FactorCasco > 0.04::DOUBLE"),
    "F8_gte": ({"field": FACTOR, "op": "gte", "value": 0.04}, "FactorCasco >= 0.04::DOUBLE"),
    "F8_lt": ({"field": FACTOR, "op": "lt", "value": 0.04}, "FactorCasco < 0.04::DOUBLE"),
    "F8_lte": ({"field": FACTOR, "op": "lte", "value": 0.04}, "FactorCasco <= 0.04::DOUBLE"),
    "F8_other_type": (
        {"any": [{"field": "antig", "op": "eq", "value": "3"}, {"field": "Pol6TTaCod", "op": "ne", "value": 3}]},
        "TRUE",
    ),
    "F9_in": (
        {"field": "Accesorios", "op": "in", "values": ["1.0, small, ring,,", None]},
        "Accesorios IS NULL OR Accesorios = '1.0, small, ring,,'",
    ),
    "F9_not_in": (
        {"field": FACTOR, "op": "not_in", "values": [0.01, 0.02, None]},
        "FactorCasco IS NULL OR FactorCasco NOT IN (0.01::DOUBLE, 0.02::DOUBLE)",
    ),
    "F10_between_both": (
        {"field": FACTOR, "op": "between", "lower": 0.02, "upper": 0.06},
        "FactorCasco >= 0.02::DOUBLE AND FactorCasco <= 0.06::DOUBLE",
    ),
    "F10_between_neither": (
        {"field": FACTOR, "op": "between", "lower": 0.02, "upper": 0.06, "inclusive": False},
        "FactorCasco > 0.02::DOUBLE AND FactorCasco < 0.06::DOUBLE",
    ),
    "F10_between_left": (
        {"field": FACTOR, "op": "between", "lower": 0.02, "upper": 0.06, "inclusive": "left"},
        "FactorCasco >= 0.02::DOUBLE AND FactorCasco < 0.06::DOUBLE",
    ),
    "F10_between_right": (
        {"field": FACTOR, "op": "between", "lower": 0.02, "upper": 0.06, "inclusive": "right"},
        "FactorCasco > 0.02::DOUBLE AND FactorCasco <= 0.06::DOUBLE",
    ),
    "F8_equal_to_nothing": ({"field": FACTOR, "op": "eq", "value": None}, "false"),
    "F8_differs_from_nothing": ({"field": FACTOR, "op": "ne", "value": None}, "true"),
    "F8_not_below_nothing": ({"not": {"field": FACTOR, "op": "lt", "value": None}}, "true"),
    "F11_is_null": ({"field": FACTOR, "op": "is_null"}, "FactorCasco IS NULL"),
    "F11_not_null": ({"field": FACTOR, "op": "not_null"}, "FactorCasco IS NOT NULL"),
}


def _register(name: str, expression: dict[str, Any] | None, condition: str) -> None:
    @query(name, sql(f"SELECT NroPoliza, antig, FactorCasco FROM portfolio WHERE {condition}"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predicate.select_rows(v.portfolio(spark, sf_dir), expression).select("NroPoliza", "antig", FACTOR)


for _name, (_expression, _condition) in SELECTIONS.items():
    _register(_name, _expression, _condition)


@query(
    "F13_free_filter",
    sql("""SELECT NroPoliza, antig, Prima FROM scored WHERE "Dataset Split" = 'test' AND antig IN (1, 2) AND Prima >= 100"""),
)
def free_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = "`Dataset Split` = 'test' AND antig IN (1, 2) AND Prima >= 100"
    return predicate.free_filter(v.scored(spark, sf_dir), condition).select("NroPoliza", "antig", "Prima")


@query(
    "F14_portfolio_filter",
    sql("""SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, antig FROM labelled
           WHERE Pol6TTaCod IN ('A', 'R') AND CoberturaLabel IN ('A', 'A2', 'D1', '40') AND antig BETWEEN 2 AND 6"""),
)
def portfolio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = predicate.portfolio_filter(v.labelled(spark, sf_dir), ["A", "R"], ["A", "A2", "D1", "40"], (2, 6))
    return kept.select("NroPoliza", "Pol6TTaCod", "CoberturaLabel", "antig")


@query("F14_age_bounds", sql("SELECT CAST(min(antig) AS BIGINT) AS lower, CAST(max(antig) AS BIGINT) AS upper FROM labelled"))
def age_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.age_bounds(v.labelled(spark, sf_dir))


@query("T3_coverage_options", sql("SELECT DISTINCT CoberturaLabel AS value FROM labelled"))
def coverage_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.option_values(v.labelled(spark, sf_dir), "CoberturaLabel")


@query("F15_finite_rows", sql("SELECT NroPoliza, Prima / FactorCasco AS ratio FROM portfolio WHERE FactorCasco <> 0"))
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col(FACTOR) == 0, F.lit(float("inf"))).otherwise(F.col("Prima") / F.col(FACTOR))
    return predicate.finite_rows(v.portfolio(spark, sf_dir).select("NroPoliza", ratio.alias("ratio")), ["ratio"])


@query("F16_test_rows", sql("""SELECT NroPoliza, Prima FROM split WHERE "Dataset Split" = 'test'"""))
def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate.by_split(v.split(spark, sf_dir), "test").select("NroPoliza", "Prima")


REFUSED_SELECTIONS = {
    "no object": [1],
    "empty list": {"all": []},
    "two joiners": {"all": [{"field": FACTOR, "op": "is_null"}], "any": [{"field": FACTOR, "op": "is_null"}]},
    "not of a list": {"not": [{"field": FACTOR, "op": "is_null"}]},
    "no such column": {"field": "nope", "op": "eq", "value": 1},
    "no operation": {"field": FACTOR},
    "no such operation": {"field": FACTOR, "op": "like", "value": 1},
    "no list": {"field": FACTOR, "op": "in", "values": 1},
    "half a range": {"field": FACTOR, "op": "between", "lower": 1},
    "no such ends": {"field": FACTOR, "op": "between", "lower": 1, "upper": 2, "inclusive": "sides"},
    "text against a number": {"field": "Marca", "op": "gt", "value": 1},
    "deep inside": {"any": [{"field": FACTOR, "op": "is_null"}, {"not": {"all": [{"field": "antig", "op": "lt", "value": "a"}]}}]},
    "fine": {"field": FACTOR, "op": "is_null"},
}


@query(
    "F12_refused_selections",
    sql("SELECT name, CASE WHEN name = 'fine' THEN (SELECT count(*) FROM portfolio WHERE FactorCasco IS NULL) END AS kept FROM (SELECT unnest(["
        + ", ".join(f"'{name}'" for name in REFUSED_SELECTIONS) + "]) AS name)"),
)
def refused_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows each selection keeps of the portfolio; none is given for those that are turned down."""
    df = v.portfolio(spark, sf_dir)

    def kept(expression: Any) -> int | None:
        try:
            return predicate.select_rows(df, expression).count()
        except ValueError:
            return None

    return spark.createDataFrame([(name, kept(case)) for name, case in REFUSED_SELECTIONS.items()], "name string, kept long")
