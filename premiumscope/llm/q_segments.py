"""Query of resampling towards the benchmark's distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.registry import query, table
from premiumscope.llm.segments import resample_by_segments


@query("op11_target_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_by_segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
