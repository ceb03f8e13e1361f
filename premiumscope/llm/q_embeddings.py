"""Query of embedding near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.cap_filters import near_vectors
from premiumscope.llm.registry import query, table


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)
