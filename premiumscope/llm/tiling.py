"""Benchmark decontamination by greedy string tiling.

Benchmark and corpus meet on shared seeds (runs of ``SEED_WORDS`` words). For every document and item with a
common seed, the longest common run of words not yet marked is marked in both, again and again down to the
seed length; runs of one length are found by Karp-Rabin fingerprints. An item is contaminated by a document
that covers enough of its words, in whatever order its passages stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.llm.common import Words, documents_of, gram_hashes, gram_range, text_slices

SEED_WORDS, COVERAGE = 5, 0.5
# Text of the benchmark that is sent to the tasks at once; a larger one goes in as many parts as it needs.
PART_BYTES = 16 << 20
MODULUS, RADIX = (1 << 61) - 1, 1_000_003


def _fingerprints(words: list[int]) -> list[int]:
    sums = [0]
    for w in words:
        sums.append((sums[-1] * RADIX + w) % MODULUS)
    return sums


def tiles(a: list[int], b: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (place in a, place in b, length), longest first, none overlapping."""
    free_a, free_b = [True] * len(a), [True] * len(b)
    sums_a, sums_b = _fingerprints(a), _fingerprints(b)
    found: list[tuple[int, int, int]] = []
    size = min(len(a), len(b))
    while size >= least:
        power = pow(RADIX, size, MODULUS)
        places: dict[int, list[int]] = {}
        for j in range(len(b) - size + 1):
            if all(free_b[j : j + size]):
                places.setdefault((sums_b[j + size] - sums_b[j] * power) % MODULUS, []).append(j)
        matches: list[tuple[int, int, int]] = []
        for i in range(len(a) - size + 1) if places else ():
            if not all(free_a[i : i + size]):
                continue
            for j in places.get((sums_a[i + size] - sums_a[i] * power) % MODULUS, ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k >= size:
                    matches.append((-k, i, j))
        longest = min(matches)[0] if matches else 0
        for k, i, j in sorted(matches):
            if k == longest and all(free_a[i : i - k]) and all(free_b[j : j - k]):
                found.append((i, j, -k))
                free_a[i : i - k] = [False] * -k
                free_b[j : j - k] = [False] * -k
        # The longest first, as long as there is one of this size or more; then shorter ones.
        if not matches:
            size = least if least < size < 2 * least else size // 2
    return found


def seeds_of(items: list[tuple[int, str]]) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray]:
    """Ids and words of some benchmark items, and their seeds in order with the item of each: plain arrays, since a
    broadcast travels to executors that need no copy of this package."""
    texts = pa.array([t for _, t in items], pa.string())
    words = Words(texts, lower=True, separators=True)
    hashes = words.hashes()
    grams = gram_hashes(hashes, SEED_WORDS)
    seeds, owners = [], []
    for k in range(len(items)):
        start, stop = gram_range(words.first, k, SEED_WORDS)
        seeds.append(grams[start:stop])
        owners.append(np.full(stop - start, k))
    seed, owner = np.concatenate(seeds), np.concatenate(owners)
    order = np.argsort(seed, kind="stable")
    return [i for i, _ in items], [hashes[a:b] for a, b in zip(words.first, words.first[1:])], seed[order], owner[order]


def _search(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_words, seeds, owners = shared.value
        for batch in text_slices(batches):
            rows: list[tuple] = []
            if len(seeds):
                words = Words(batch.column("text"), lower=True, separators=True)
                hashes = words.hashes()
                grams = gram_hashes(hashes, SEED_WORDS)
                spot = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
                hit = seeds[spot] == grams
                docs = batch.column("doc_id").to_pylist()
                hits = np.flatnonzero(hit)
                touched = np.unique(np.searchsorted(words.first, hits, side="right") - 1)
                for i in touched.tolist():
                    start, stop = gram_range(words.first, i, SEED_WORDS)
                    own = np.flatnonzero(hit[start:stop])
                    low = np.searchsorted(seeds, grams[start + own], side="left")
                    high = np.searchsorted(seeds, grams[start + own], side="right")
                    places: dict[int, list[int]] = {}
                    for at, x, y in zip(own.tolist(), low.tolist(), high.tolist()):
                        for k in set(owners[x:y].tolist()):
                            places.setdefault(k, []).append(at)
                    for k, seen in places.items():
                        # Only words under a common seed can be in a tile; a gap is one word that equals no other.
                        cover = np.unique(np.add.outer(np.array(seen), np.arange(SEED_WORDS)))
                        text: list[int] = []
                        origin: list[int] = []
                        for c, h in zip(cover.tolist(), hashes[start + cover].tolist()):
                            if origin and c != origin[-1] + 1:
                                text.append(-1)
                                origin.append(-1)
                            text.append(h)
                            origin.append(c)
                        found = tiles(text, item_words[k].tolist())
                        covered = sum(n for _, _, n in found)
                        share = covered / len(item_words[k])
                        if share >= coverage:
                            spans = [(origin[x], origin[x] + n) for x, _, n in sorted(found)]
                            first = words.first[i]
                            chars = [(int(words.starts[first + x] - words.offsets[i]), int(words.ends[first + y - 1] - words.offsets[i]))
                                     for x, y in spans]
                            rows.append((docs[i], ids[k], covered, share, len(found), [v for c in chars for v in c]))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=SCHEMA.fieldNames())

    return run


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_covered", T.LongType()),
    T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()), T.StructField("bytes", T.ArrayType(T.LongType())),
])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item it covers to at least ``coverage``: doc_id, item_id, n_covered,
    coverage, n_tiles and ``bytes`` (first and end byte of each tile in the document's UTF-8 text).

    Words are runs of letters and digits, lower-cased in A-Z, so markup between words does not matter. Null texts
    have no words; items of fewer than ``SEED_WORDS`` words match nothing, as chance could not be told from a
    leak. Repeated rows give repeated results; null ids are carried along; other columns are not looked at; empty
    tables give an empty result. The benchmark is sent to the tasks in parts of at most ``PART_BYTES`` of text
    (one longer item alone), the corpus is read once per part and never shuffled.
    """
    items = documents_of(benchmark, "item_id", "text").filter("text IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // PART_BYTES)) if size > PART_BYTES else 1
    result = None
    for number in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == number)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(seeds_of(rows or [(0, "")]))
        found = texts.mapInArrow(_search(shared, coverage), SCHEMA)
        result = found if result is None else result.union(found)
    return result
