"""Queries of token counts and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.packing import pack_documents
from premiumscope.llm.registry import query, table
from premiumscope.llm.token_counts import token_counts


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=512)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
