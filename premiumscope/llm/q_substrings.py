"""Query of the removal of repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.registry import query, table
from premiumscope.llm.substrings import remove_repeats


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), width=20)
