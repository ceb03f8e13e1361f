"""Table sinks. All of them write from the executors; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premiumscope.functions.numeric import col, nan_to_null
from premiumscope.operators.scale import numbered_ranges, running_total
from premiumscope.operators.validate import Triage
from premiumscope.spec import APE, IDENTITY_COLUMN

ONE_FILE_ROWS = 100_000
ERROR_RANK = "Error rank"


def write_table(df: DataFrame, path: str, codec: str | None = None) -> str:
    """Parquet, NaN stored as NULL. ``codec`` is the compression, by default that of the session."""
    nan_to_null(df).write.mode("overwrite").parquet(path, compression=codec)
    return path


def doubtful_path(path: str) -> str:
    """``name.parquet`` -> ``name_doubtful.parquet``."""
    head, dot, tail = path.rstrip("/").rpartition(".")
    return f"{head}_doubtful.{tail}" if dot and "/" not in tail else f"{path.rstrip('/')}_doubtful"


def write_clean_and_doubtful(result: Triage, path: str, rejected_path: str | None = None) -> tuple[str, str]:
    """Two complementary tables; unused pair columns are dropped from the clean one only."""
    rejected_path = rejected_path or doubtful_path(path)
    return write_table(result.clean_without_unused_pairs(), path), write_table(result.doubtful, rejected_path)


def by_error(scored: DataFrame) -> DataFrame:
    """Largest percentage error first, undefined errors last: a range-partitioned sort."""
    return scored.orderBy(col(APE).desc_nulls_last())


def write_sorted_by_error(scored: DataFrame, path: str, file_format: str = "csv", identity: str = IDENTITY_COLUMN) -> str:
    """Rows by descending percentage error (undefined last, ties by identity) with their place as ``ERROR_RANK``.

    Files follow each other in that order, and the place beside each row lets a reader check it. CSV files are packed
    by gzip, Parquet files by zstd; readers see that from the name and the file.
    """
    error = col(APE)
    # Descending and undefined last, as a key that ascends; NaN counts as the largest number.
    kind = F.when(error.isNull(), 2).when(F.isnan(error), 0).otherwise(1)
    key = [kind, F.coalesce(-F.nanvl(error, F.lit(0.0)), F.lit(0.0)), col(identity)]
    ordered = numbered_ranges(scored, key, ERROR_RANK)
    packed = {"csv": "gzip", "parquet": "zstd"}.get(file_format)
    writer = ordered.write.mode("overwrite").option("header", True).format(file_format)
    (writer.option("compression", packed) if packed else writer).save(path)
    return path


def write_metrics(metrics: DataFrame, path: str, run_id: str, file_format: str = "json") -> str:
    """Long-form metrics, one folder per run. Writing a run again replaces its folder and no other."""
    tagged = metrics.withColumn("run_id", F.lit(run_id))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").format(file_format).save(path)
    return path


def write_top_rows(df: DataFrame, path: str, rows: int, order_by: Sequence[Column] = ()) -> str:
    """CSV with the first ``rows`` of a ranked table: one file up to ``ONE_FILE_ROWS``.

    Beyond it the rows are numbered by ``order_by`` over sorted ranges and written as several files in that order, so
    that no task holds them all.
    """
    if rows <= ONE_FILE_ROWS:
        top = (df.orderBy(*order_by) if order_by else df).limit(rows).coalesce(1)
    elif not order_by:
        raise ValueError(f"{rows} rows do not go into one file (at most {ONE_FILE_ROWS}); say by which columns they are ordered")
    else:
        numbered = running_total(df, list(order_by), out="_place").filter(F.col("_place") <= rows)
        top = numbered.repartitionByRange(-(-rows // ONE_FILE_ROWS), "_place").sortWithinPartitions("_place").drop("_place")
    top.write.mode("overwrite").option("header", True).csv(path)
    return path


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
