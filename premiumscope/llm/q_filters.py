"""Queries of benchmark decontamination and quality resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.llm.registry import query, table
from premiumscope.llm.resampling import resample
from premiumscope.llm.tiling import contaminated


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_covered", F.round("coverage", 6).alias("coverage"), "n_tiles")


@query("op5_importance_resampling")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good)
