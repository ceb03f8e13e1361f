"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.functions.numeric import nan_to_null


def read_table(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """Parquet table with NaN read as NULL.

    ``trusted`` marks a table written by this package, which holds no NaN: columns are then passed through
    untouched, so filters on floating columns reach the scan.
    """
    df = spark.read.parquet(path)
    return df if trusted else nan_to_null(df)


def read_raw_portfolio(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Raw portfolio with a header row, every column as text (types are settled by the encoder). Paths
    ending in ``.parquet`` are read as Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return read_table(spark, path)
    return spark.read.option("header", True).option("sep", separator).csv(path)


def read_metrics(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Metrics of all runs below ``path``, tagged with their run id."""
    return spark.read.format(file_format).load(path)
