"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.language_id import language_id
from premiumscope.llm.registry import query, table


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
