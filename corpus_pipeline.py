"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Columns of documents: doc_id, text, lang, source, n_chars. Every stage works on all rows its predecessor kept, and a
decision about a row concerns that row: rows are told apart by their id and a hash of their text, so rows without an id
and rows that repeat one are decided by their own text. Rows equal in both are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.llm.common import Scratch, small_batches
from premiumscope.llm.language_id import UNDETERMINED, held_out, identify, train_prototypes
from premiumscope.llm.ngram_join import ngram_join
from premiumscope.llm.packing import pack_documents
from premiumscope.llm.pii import fit_spans, redact
from premiumscope.llm.tiling import contaminated

#: Stages are not expressible in SQL (trained models, a tokenizer); tests compare them with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` becomes the prediction. Null texts and texts without letters go."""
    small_batches(spark)
    training = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    named = identify(docs, train_prototypes(training.select("text", "lang")))
    kept = named.filter(F.col("lang_pred") != UNDETERMINED).withColumn("lang", F.col("lang_pred"))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, rows without an id last, ties by the text's hash.

    Copies with one id and one text are near copies of each other, so one of them stays. Texts without words are no
    copies of anything: all their rows stay. The rows that go are written first: Spark then knows their size, and sends
    them to the documents instead of shuffling whole texts as long as they are few.
    """
    scratch = Scratch(spark, "near-copies")
    named = scratch.keep(ngram_join(docs).select(F.col("doc_id").alias("id"), "print", "component").filter("component IS NOT NULL"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "print")
    first = named.groupBy("component").agg(F.min(order).alias("first"))
    rows = named.groupBy("component", "id", "print").agg(F.count(F.lit(1)).alias("copies"))
    rows = scratch.keep(rows.join(first, "component").withColumn("stays", order == F.col("first")).drop("component", "first"))
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_print": F.xxhash64("text")})
    gone = rows.filter("NOT stays")
    kept = keyed.join(gone, keyed["_id"].eqNullSafe(gone["id"]) & (keyed["_print"] == gone["print"]), "left_anti")
    # Of rows that are kept and equal in id and text one stays; only they are moved.
    several = scratch.keep(rows.filter("stays AND copies > 1").select("id", "print"))
    same = kept["_id"].eqNullSafe(several["id"]) & (kept["_print"] == several["print"])
    single = kept.join(several, same, "left_anti").unionByName(kept.join(several, same, "left_semi").dropDuplicates(["_id", "_print"]))
    return single.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item; a row goes or stays by its own text, whatever rows share its id."""
    small_batches(spark)
    scratch = Scratch(spark, "decontamination")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = scratch.keep(contaminated(texts, items).select(F.col("doc_id").alias("_print")).distinct())
    return docs.withColumn("_print", F.xxhash64("text")).join(found, "_print", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text. Null texts stay null."""
    small_batches(spark)
    cleaned = redact(docs, fit_spans(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null text is one piece with the end id alone."""
    small_batches(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result is the last stage's table, read again. No documents, no pieces."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
