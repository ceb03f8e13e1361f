"""Importance resampling of documents towards a target quality.

Target and raw text are each modelled as a bag of hashed word uni- and bigrams. A document's log weight is the
log ratio of the two models; sampling without replacement in proportion to the weights is a top-k selection of
log weight plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import Scratch, Words, documents_of, gram_hashes, mix, text_slices

BUCKETS = 10_000
# Target documents the target model is fitted on at most: those with the smallest hash of their id.
TARGET_SAMPLE = 20_000
# A document counts as this many n-grams whatever its length, so that length does not decide the sampling.
EVEN_LENGTH = 50.0
KEEP_SHARE, SEED = 0.5, 11


def _buckets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every uni- and bigram of a slice, and its text."""
    words = Words(batch.column("text"), lower=True, separators=True)
    hashes, counts = words.hashes(), words.counts()
    text = np.repeat(np.arange(batch.num_rows), counts)
    pairs = gram_hashes(hashes, 2)
    inside = text[1:] == text[:-1]
    grams = np.concatenate((hashes, pairs[inside[: len(pairs)]]))
    owner = np.concatenate((text, text[: len(pairs)][inside[: len(pairs)]]))
    return (grams % np.uint64(BUCKETS)).astype(np.int64), owner


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in text_slices(batches):
        total += np.bincount(_buckets(batch)[0], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "times"])


def _model(texts: DataFrame) -> np.ndarray:
    """Log probability per bucket; at most ``BUCKETS`` rows reach the driver."""
    counted = texts.mapInArrow(_counts, "bucket int, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    total = np.ones(BUCKETS)
    for row in counted.collect():
        total[row["bucket"]] += row["times"]
    return np.log(total / total.sum())


def _weigh(ratio: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bucket, owner = _buckets(batch)
            sums = np.bincount(owner, weights=ratio[bucket], minlength=batch.num_rows)
            sizes = np.bincount(owner, minlength=batch.num_rows)
            weight = np.round(EVEN_LENGTH * sums / np.maximum(sizes, 1), 6)
            ids = np.array([-1 if d is None else d for d in batch.column("doc_id").to_pylist()], dtype=np.int64)
            noise = mix(mix(ids.view(np.uint64)) + np.uint64(seed)) >> np.uint64(11)
            uniform = (noise.astype(np.float64) + 0.5) / 2**53
            key = np.round(weight - np.log(-np.log(uniform)), 6)
            empty = sizes == 0
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.where(empty, 0.0, weight)),
                                   pa.array(key, mask=empty)], names=["doc_id", "log_weight", "key"])

    return run


def _kth_largest(keys: DataFrame, k: int) -> tuple[int, int]:
    """(v, n): exactly n < k values are above v and at least k are v or above, for whole numbers in ``key``.

    Four counting passes over the table of keys; each sees 16 more bits, so 65,536 counts reach the driver.
    """
    low, above = -(1 << 63), 0
    for shift in (48, 32, 16, 0):
        width = 1 << shift
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= low + (width << 16) - 1))
        slot = F.shiftright("key", shift) - F.lit(low >> shift)
        counts = {r["slot"]: r["count"] for r in inside.groupBy(slot.alias("slot")).count().collect()}
        for place in sorted(counts, reverse=True):
            if above + counts[place] >= k:
                low += place * width
                break
            above += counts[place]
    return low, above


def resample(docs: DataFrame, target_ids: DataFrame, keep_share: float = KEEP_SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and kept of every row of ``docs``; ``keep_share`` of the rows with words are kept.

    ``target_ids(doc_id)`` names documents of the target quality. A null or wordless text has weight 0 and is not
    kept. The noise depends on the id alone, so a repeated row is treated as its copy; rows with one key at the
    border are kept together. Null ids are carried along with common noise. Other columns are not looked at; an
    empty table gives an empty result, and without any target document all weights are those of a flat target.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    chosen = (target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_SAMPLE))
    target = texts.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    ratio = _model(target) - _model(texts.select("text"))
    weighed = scratch.keep(texts.mapInArrow(_weigh(ratio, seed), "doc_id long, log_weight double, key double"))
    keys = weighed.filter("key IS NOT NULL").select(F.round(F.col("key") * 1_000_000).cast("long").alias("key"))
    k = int(keys.count() * keep_share)
    if k == 0:
        return weighed.select("doc_id", "log_weight", F.lit(False).alias("kept"))
    bound, _ = _kth_largest(keys, k)
    kept = F.coalesce(F.round(F.col("key") * 1_000_000).cast("long") >= bound, F.lit(False))
    return weighed.select("doc_id", "log_weight", kept.alias("kept"))
