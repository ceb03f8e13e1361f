"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premiumscope.llm.ngram_join import ngram_join
from premiumscope.llm.registry import query, table


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")
