"""Validity checks, triage, strata, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.catalogue.registry import query, rounded
from premiumscope.catalogue.sql import FOLDS as FOLDS_SQL
from premiumscope.catalogue.sql import SPLIT as SPLIT_SQL
from premiumscope.catalogue.sql import r, sql
from premiumscope.functions.labels import text_or_missing
from premiumscope.functions.numeric import col
from premiumscope.operators import split, validate
from premiumscope.operators.scale import materialise, spread_join
from premiumscope.operators.split import (
    FOLD,
    joint_stratum,
    plain_folds,
    plain_holdout,
    stratified_holdout,
    stratum_counts,
    stratum_number,
)
from premiumscope.spec import SPLIT


@query("F1_sum_consistent", sql("SELECT NroPoliza, sum_ok FROM checked"))
def sum_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.labelled(spark, sf_dir).select(
        "NroPoliza", validate.sum_consistent(v.COMPONENTS, v.TOTAL).alias("sum_ok")
    )


@query("F2_premiums_nonnegative", sql("SELECT NroPoliza, nonneg FROM checked"))
def premiums_nonnegative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.labelled(spark, sf_dir).select(
        "NroPoliza", validate.premiums_nonnegative(v.SPEC.targets).alias("nonneg")
    )


@query("F3_coverage_present", sql("SELECT NroPoliza, has_coverage FROM checked"))
def coverage_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.labelled(spark, sf_dir).select(
        "NroPoliza", validate.coverage_present(v.SPEC.coverage).alias("has_coverage")
    )


@query("F4_pair_frequency", sql("SELECT NroPoliza, pair_count, pair_count >= 300 AS frequent FROM counted"))
def pair_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = v.triaged(spark, sf_dir, 300).flagged
    return flagged.select("NroPoliza", F.col("_pair_count").alias("pair_count"), F.col("_frequent").alias("frequent"))


CLEAN_300 = "sum_ok AND nonneg AND has_coverage AND pair_count >= 300"
REASONS_300 = """concat_ws('; ',
  CASE WHEN NOT sum_ok THEN 'Prima component sum mismatch' END, CASE WHEN NOT nonneg THEN 'Negative Prima value' END,
  CASE WHEN NOT has_coverage THEN 'Missing Cobertura' END,
  CASE WHEN has_coverage AND pair_count < 300 THEN 'Rare Pol6TTaCod/Cobertura pair (<300 rows)' END)"""


@query("F5_clean_rows", sql(f"SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, Prima FROM counted WHERE {CLEAN_300}"))
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.triaged(spark, sf_dir, 300).clean.select("NroPoliza", "Pol6TTaCod", "CoberturaLabel", "Prima")


@query(
    "F5_doubtful_rows",
    sql(f"""SELECT NroPoliza, {r('difference', 'PrimaSumDifference')}, pair_count AS TariffCoveragePairCount,
                   {REASONS_300} AS DoubtfulReason FROM counted WHERE NOT ({CLEAN_300})"""),
)
def doubtful_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["NroPoliza", "PrimaSumDifference", "TariffCoveragePairCount", "DoubtfulReason"]
    return rounded(v.triaged(spark, sf_dir, 300).doubtful.select(*names))


@query(
    "F5_reason_counts",
    sql(f"""SELECT Pol6TTaCod, CoberturaLabel, {REASONS_300} AS DoubtfulReason, count(*) AS "rows" FROM counted
            WHERE NOT ({CLEAN_300}) GROUP BY ALL"""),
)
def reason_counts(spark: SparkSession, sf_dir: str, min_pair_count: int = 300) -> DataFrame:
    """Which rows cannot be trusted, and why, by tariff and coverage."""
    doubtful = v.triaged(spark, sf_dir, min_pair_count).doubtful
    return doubtful.groupBy("Pol6TTaCod", "CoberturaLabel", "DoubtfulReason").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "U1_complementary_parts",
    sql(f"""SELECT count(*) FILTER ({CLEAN_300}) AS clean, count(*) FILTER (NOT ({CLEAN_300})) AS doubtful, count(*) AS "rows"
            FROM counted"""),
)
def complementary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = v.triaged(spark, sf_dir, 300)
    parts = result.clean.select(F.lit("clean").alias("part")).unionByName(result.doubtful.select(F.lit("doubtful").alias("part")))
    return parts.agg(
        F.count_if(F.col("part") == "clean").alias("clean"),
        F.count_if(F.col("part") == "doubtful").alias("doubtful"),
        F.count(F.lit(1)).alias("rows"),
    )


@query("J1_salted_pair_counts", sql("SELECT NroPoliza, pair_count FROM counted"))
def salted_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join used when a lookup is too large to broadcast: heavy pairs are found and spread over salts."""
    rows = v.labelled(spark, sf_dir)
    valid = (
        validate.sum_consistent(v.COMPONENTS, v.TOTAL)
        & validate.premiums_nonnegative(v.SPEC.targets)
        & validate.coverage_present(v.SPEC.coverage)
    )
    counts = validate.pair_counts(rows, valid, v.SPEC.tariff, v.SPEC.coverage)
    keyed = rows.select(
        "NroPoliza",
        text_or_missing(col(v.SPEC.tariff)).alias("_tariff"),
        text_or_missing(col(v.SPEC.coverage)).alias("_coverage"),
    )
    joined = spread_join(keyed, counts, ["_tariff", "_coverage"], key_rows=500)
    return joined.select("NroPoliza", F.coalesce("_eligible", F.lit(0)).alias("pair_count"))


@query("A1_pair_counts", sql("SELECT stratum AS \"Stratum\", n AS \"rows\" FROM strata"))
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratum_counts(v.clean(spark, sf_dir), v.SPEC.strata)


@query("A2_stratum_number", sql("SELECT count(*) AS strata FROM strata"))
def number_of_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratum_number(v.clean(spark, sf_dir), v.SPEC.strata)


@query(
    "A13_guard_report",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < 0) AS negative, count(*) FILTER ({c} IS NULL) AS missing,"
            f" count(*) FILTER (isinf({c}) OR isnan({c})) AS not_finite FROM portfolio"
            for c in ("FactorCasco", "PrimaRC", "PrimaAccesorio", "Prima")
        )
    ),
)
def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.guard_report(
        v.portfolio(spark, sf_dir), ["FactorCasco", "PrimaRC", "PrimaAccesorio", "Prima"]
    )


@query("K1_joint_strata", sql("SELECT NroPoliza, Pol6TTaCod || chr(31) || coalesce(Accesorios, 'Missing') AS \"Stratum\" FROM portfolio"))
def joint_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir)
    return df.select("NroPoliza", joint_stratum(df, ["Pol6TTaCod", "Accesorios"]).alias("Stratum"))


@query("K2_stratified_split", sql('SELECT NroPoliza, "Dataset Split" FROM split'))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.split(spark, sf_dir).select("NroPoliza", SPLIT)


@query(
    "K2_split_shares",
    sql("""SELECT Pol6TTaCod, CoberturaLabel, count(*) AS "rows", count(*) FILTER ("Dataset Split" = 'test') AS test_rows
           FROM split GROUP BY ALL"""),
)
def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.split(spark, sf_dir).groupBy("Pol6TTaCod", "CoberturaLabel").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(col(SPLIT) == "test").alias("test_rows")
    )


@query("K3_stratified_folds", sql("SELECT NroPoliza, Fold FROM folded"))
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.folded(spark, sf_dir).select("NroPoliza", FOLD)


PLAIN = """
plain AS (
  SELECT NroPoliza, row_number() OVER (ORDER BY md5(concat_ws('|', '42', NroPoliza))) - 1 AS r, count(*) OVER () AS n FROM portfolio
)"""


@query(
    "K4_plain_split",
    sql("""SELECT NroPoliza, CASE WHEN r < ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS "Dataset Split" FROM plain""", PLAIN),
)
def plain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unstratified: the one group holds every row, so its cut is searched digit by digit."""
    return plain_holdout(v.portfolio(spark, sf_dir).select("NroPoliza"), ["NroPoliza"], slice_rows=50)


@query(
    "K4_plain_folds",
    sql("""SELECT NroPoliza, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
             ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS Fold FROM plain""", PLAIN),
)
def unstratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_folds(v.portfolio(spark, sf_dir).select("NroPoliza"), ["NroPoliza"], 5, slice_rows=50)


@query("W2_large_stratum_split", sql('SELECT NroPoliza, "Dataset Split" FROM split'))
def large_stratum_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified split on the path taken by strata too large to be ranked whole."""
    rows = v.clean(spark, sf_dir)
    return stratified_holdout(rows, v.SPEC.strata, ["NroPoliza"], v.TEST_SIZE, v.SEED, slice_rows=50).select("NroPoliza", SPLIT)


REPEATED = """
repeated AS (
  SELECT split_part(NroPoliza, '-', 1) AS policy, * FROM clean
  UNION ALL SELECT split_part(NroPoliza, '-', 1), * FROM clean WHERE antig % 2 = 0
  UNION ALL SELECT split_part(NroPoliza, '-', 1), * FROM clean WHERE antig % 4 = 0
),
"""
REPEATED_SPLIT = (
    SPLIT_SQL.replace("FROM clean", "FROM repeated")
    .replace("concat_ws('|', '42', NroPoliza)) AS key", "concat_ws('|', '42', policy)) || md5(NroPoliza) AS key")
    .replace("keyed", "repeated_keyed").replace("strata", "repeated_strata").replace("sizes", "repeated_sizes")
    .replace("shares", "repeated_shares").replace("quotas", "repeated_quotas").replace("split AS", "repeated_split AS")
)
REPEATED_FOLDS = (
    FOLDS_SQL.replace("fold_strata", "repeated_fold_strata").replace("fold_ranks", "repeated_fold_ranks")
    .replace("folded", "repeated_folded").replace("keyed", "repeated_keyed").replace("FROM strata", "FROM repeated_strata")
)


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the order as their id, which several policies share, and with two to three equal copies of some."""
    rows = v.stored_clean(spark, sf_dir).withColumn("policy", F.split_part(col("NroPoliza"), F.lit("-"), F.lit(1)))
    again = F.expr("explode(filter(array(true, antig % 2 = 0, antig % 4 = 0), x -> x))").alias("_again")
    return materialise(rows.select("policy", "NroPoliza", *[col(name) for name in v.SPEC.strata], again).drop("_again"))


@query("K2_repeated_ids", sql('SELECT NroPoliza, "Dataset Split" FROM repeated_split', REPEATED.strip().rstrip(","), REPEATED_SPLIT))
def repeated_ids_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one id are ordered by a hash of the row, equal rows are counted off."""
    rows = _repeated(spark, sf_dir)
    return stratified_holdout(rows, v.SPEC.strata, ["policy"], v.TEST_SIZE, v.SEED, tie=["NroPoliza"]).select("NroPoliza", SPLIT)


@query(
    "K3_repeated_ids",
    sql("SELECT NroPoliza, Fold FROM repeated_folded", REPEATED.strip().rstrip(","), REPEATED_SPLIT, REPEATED_FOLDS),
)
def repeated_ids_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _repeated(spark, sf_dir)
    return split.stratified_folds(rows, v.SPEC.strata, ["policy"], v.FOLDS, v.SEED, tie=["NroPoliza"]).select("NroPoliza", FOLD)
