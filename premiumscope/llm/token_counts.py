"""Token counts by a two-tier lookup: a broadcast table of frequent pieces, then each worker's own cache."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import documents_of, text_slices
from premiumscope.llm.pretokens import PieceCache, coder, vocabulary_path

# Rows of the broadcast table, and candidates each task proposes for it: both bound what leaves a task.
FREQUENT, PROPOSED, WATCHED = 20_000, 4_000, 200_000
MAX_PIECE_CHARS = 64


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pieces of a task with their counts. The watch list is cut to its larger half when
    it is full, so memory is bounded; all texts are read."""
    seen: Counter = Counter()
    for batch in text_slices(batches):
        for text in batch.column("text").to_pylist():
            if text:
                seen.update(text.split(" "))
        if len(seen) > WATCHED:
            seen = Counter(dict(seen.most_common(WATCHED // 2)))
    top = [(p, n) for p, n in seen.most_common(PROPOSED) if p and len(p) <= MAX_PIECE_CHARS]
    yield pa.record_batch([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                          names=["piece", "seen"])


def frequent_pieces(docs: DataFrame) -> list[str]:
    """Pieces that many tasks find frequent, at most ``FREQUENT``. They only warm up the lookup."""
    counted = documents_of(docs, "text").mapInArrow(_propose, "piece string, seen long").groupBy("piece").agg(F.sum("seen").alias("seen"))
    return [r["piece"] for r in counted.orderBy(F.desc("seen"), "piece").limit(FREQUENT).collect()]


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None, frequent: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no row is moved between tasks.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and null ids stay as they are; columns other
    than doc_id and text are not looked at. An empty table gives an empty result. Texts are read whole, one at
    a time, so a very long one costs memory in proportion to itself.
    """
    path = path or vocabulary_path()
    pieces = frequent_pieces(docs) if frequent is None else frequent
    encode = coder(path).ids
    lengths = {piece: len(encode(" " + piece)) for piece in pieces}
    table = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceCache(path, table.value)
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            tokens = [cache.count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
