"""A portfolio of priced policies derived from the ``lineitem`` and ``part`` tables, and its later stages.

Money is computed in whole cents, so the values are the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.functions.numeric import col
from premiumscope.operators import encode
from premiumscope.operators.models import ExpressionScorer, PairMeanScorer, scored_table
from premiumscope.operators.predicate import by_split
from premiumscope.operators.scale import materialise
from premiumscope.operators.scenario import counterfactual_table
from premiumscope.operators.split import stratified_folds, stratified_holdout
from premiumscope.operators.validate import Triage, triage
from premiumscope.sources.readers import read_table
from premiumscope.spec import PortfolioSpec

SPEC = PortfolioSpec()
COMPONENTS = list(SPEC.components)
TOTAL, ID = SPEC.total, SPEC.identity
PREDICTIONS = [f"{c} Prediction" for c in COMPONENTS]
MIN_PAIR = 20
SEED, FOLDS, TEST_SIZE = 42, 3, 0.2
MONEY = 2

SCENARIO = {
    "selection": {
        "all": [
            {"field": "antig", "op": "between", "lower": 2, "upper": 5, "inclusive": True},
            {"field": "Pol6TTaCod", "op": "eq", "value": "R"},
        ]
    },
    "feature_changes": [{"field": "TasaCasco", "op": "increase_pct", "value": 15}],
    "prediction_adjustments": [{"component": "PrimaRC", "op": "increase_pct", "value": 10}],
}
FORMULAS = {
    "PrimaRC": "SumaAsegurada * 0.04D",
    "PrimaCasco": "SumaAsegurada * TasaCasco",
    "PrimaClausulaAjuste": "SumaAsegurada * FactorCasco * 0.1D",
    "PrimaAccesorio": "antig * 5.0D + 10.0D",
}
FORMULA_FEATURES = ["SumaAsegurada", "TasaCasco", "FactorCasco", "antig"]


SMALL_TABLE_BYTES = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", trusted=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small table in fewer files than there are cores would be computed by a few tasks: deal its rows
    out first, by a key, which needs no sort. Larger tables are scanned as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < SMALL_TABLE_BYTES and len(df.inputFiles()) < cores else df


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").withColumns(
        {
            # The sources have two decimals and no negative value; this is rounding without BigDecimal.
            "cents": (F.col("l_extendedprice") * 100 + 0.5).cast("long"),
            "tax": (F.col("l_tax") * 100 + 0.5).cast("long"),
            "disc": (F.col("l_discount") * 100 + 0.5).cast("long"),
        }
    )
    joined = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cents = joined.withColumns(
        {
            "c1": F.expr("cents * 4 div 100"),
            "c2": F.expr("cents * tax div 100"),
            "c3": F.expr("cents * disc div 1000"),
            "c4": F.expr("CASE WHEN l_partkey % 151 = 0 THEN -100 ELSE CAST(l_quantity AS INT) * 50 END"),
        }
    )
    return cents.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) AS NroPoliza",
        "l_returnflag AS Pol6TTaCod",
        "CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE p_size END AS Cobertura",
        "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE "
        "concat(CAST(p_size % 5 AS STRING), '.0, ', replace(p_name, ' ', ', '), ',,') END AS Accesorios",
        "2002 - year(l_shipdate) AS antig",
        "l_tax AS TasaCasco",
        "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_discount END AS FactorCasco",
        "CAST(cents AS DOUBLE) / 100 AS SumaAsegurada",
        "CAST(l_linenumber AS STRING) AS ModoFacturacion",
        "p_brand AS Marca",
        "CAST(c1 AS DOUBLE) / 100 AS PrimaRC",
        "CAST(c2 AS DOUBLE) / 100 AS PrimaCasco",
        "CAST(c3 AS DOUBLE) / 100 AS PrimaClausulaAjuste",
        "CAST(c4 AS DOUBLE) / 100 AS PrimaAccesorio",
        "CAST(c1 + c2 + c3 + c4 + CASE WHEN l_partkey % 97 = 0 THEN 100 ELSE 0 END AS DOUBLE) / 100 AS Prima",
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.fill_label(encode.add_coverage_label(portfolio(spark, sf_dir)))


def triaged(spark: SparkSession, sf_dir: str, min_pair_count: int = MIN_PAIR) -> Triage:
    return triage(labelled(spark, sf_dir), COMPONENTS, TOTAL, min_pair_count=min_pair_count)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triaged(spark, sf_dir).clean


def stored_clean(spark: SparkSession, sf_dir: str, codec: str | None = None) -> DataFrame:
    """The clean rows over labelled rows that are written once: pair counts, cut search, labelling and fitting read them.

    A forest's draws follow the files its rows lie in, so ``codec`` is left alone where one is fitted."""
    return triage(materialise(labelled(spark, sf_dir), codec=codec), COMPONENTS, TOTAL, min_pair_count=MIN_PAIR).clean


def split(spark: SparkSession, sf_dir: str, codec: str | None = None) -> DataFrame:
    return stratified_holdout(stored_clean(spark, sf_dir, codec), SPEC.strata, [ID], TEST_SIZE, SEED)


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_folds(stored_clean(spark, sf_dir), SPEC.strata, [ID], FOLDS, SEED)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows scored by the per-pair means of the training rows."""
    rows = split(spark, sf_dir, "zstd")
    scorer = PairMeanScorer(by_split(rows, "train"), SPEC.strata, COMPONENTS, MONEY)
    return scored_table(rows, scorer, TOTAL, ID)


def numeric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.fill_features(clean(spark, sf_dir), SPEC.targets)


def formula_scorer() -> ExpressionScorer:
    return ExpressionScorer(FORMULAS, FORMULA_FEATURES)


def counterfactual(spark: SparkSession, sf_dir: str, check: bool = True) -> DataFrame:
    excluded = [*SPEC.targets, ID]
    return counterfactual_table(
        formula_scorer(), numeric_clean(spark, sf_dir), SCENARIO, TOTAL, excluded, check=check
    )


def hot_names(df: DataFrame, prefix: str) -> DataFrame:
    """(identity, name) of every 0/1 column that is set: a wide encoding reshaped for comparison."""
    flags = F.array(
        *[
            F.struct(F.lit(name).alias("name"), col(name).cast("int").alias("flag"))
            for name in df.columns
            if name.startswith(prefix)
        ]
    )
    hot = F.transform(F.filter(flags, lambda x: x["flag"] == 1), lambda x: x["name"])
    return df.select(col(ID), F.explode(hot).alias("name"))
