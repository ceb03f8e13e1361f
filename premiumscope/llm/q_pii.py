"""Query of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.pii import find_personal_data, fit_spans
from premiumscope.llm.registry import query, table


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit_spans(docs))
