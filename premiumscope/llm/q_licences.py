"""Query of licence scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.licences import licence_scan
from premiumscope.llm.registry import query, table


@query("op7_licence_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))
