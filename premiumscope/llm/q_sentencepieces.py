"""Query of the SentencePiece round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.llm.registry import query, table
from premiumscope.llm.sentencepieces import decode, encode


@query("op13_sentencepiece_codec")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
