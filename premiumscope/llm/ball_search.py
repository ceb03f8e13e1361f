"""Ranked lexical search: exact inner products of sparse vectors, found in ball trees.

A document is a vector of whole-number impacts over the terms of the queries, a query a vector of whole-number term
weights; the score is their inner product. Every task packs its documents into blocks of bounded size and builds a tree
over each: a node holds a centroid and, for every group of terms, the largest distance of its documents from the
centroid within the group. For a query q the inner product with any document below the node is then at most

    <q, centroid> + sum over groups of |q in the group| * radius of the group

(Cauchy-Schwarz, group by group; one group of all terms is the plain ball, whose radius sums up what documents do with
terms that the query never names). Terms are scaled by the root of their weight on both sides, which leaves the product
alone. Nodes are visited best bound first; the walk ends when the best open bound is below the tenth score found so far
in the task. Bounds are rounded up by more than their floating-point error, leaves are scored in 64-bit integers, so the
result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premiumscope.llm.common import Scratch, Words, documents_of, text_slices

TOP = 10
LEAF, GROUP_TERMS = 16, 4
# Bytes of the dense block a tree is built over, and of item text whose terms are searched at once.
BLOCK_BYTES, PART_BYTES = 1 << 24, 1 << 17
# Tasks whose lists are merged together before the last merge.
MERGED = 256


# ---- vectors ------------------------------------------------------------------------------------------

def _terms(array: pa.Array) -> Words:
    return Words(array, lower=True, separators=True)


class Queries:
    """Items as vectors over a sorted vocabulary of their terms (by 64-bit fingerprint)."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        words = _terms(pa.array([t for _, t in items], pa.string()))
        self.terms, place = np.unique(words.hashes(), return_inverse=True)
        self.items = [np.unique(place[a:b], return_counts=True) for a, b in zip(words.first, words.first[1:])]


def _vectors(vocabulary):
    """doc_id, n (all terms), and which terms of the vocabulary a document holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in text_slices(batches):
            words = _terms(batch.column("text"))
            hashes, counts = words.hashes(), words.counts()
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
            text = np.repeat(np.arange(batch.num_rows), counts)[hit]
            both, times = np.unique(text * len(known) + at[hit], return_counts=True)
            text, term = np.divmod(both, max(len(known), 1))
            offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, times)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "times"])

    return run


def impact(times: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """How much an occurrence count says in a document of n terms, in whole numbers."""
    m = 100 - 75 + (75 * n * documents) // max(occurrences, 1)
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def term_weights(found: list[int], documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in found], dtype=np.int64)


# ---- trees --------------------------------------------------------------------------------------------

class BallTree:
    """A ball tree over the rows of ``impacts`` (whole numbers below 2**24 held as 32-bit floats)."""

    def __init__(self, impacts: np.ndarray, scale: np.ndarray, leaf: int = LEAF, group_terms: int = GROUP_TERMS):
        self.scale = scale
        self.group = np.arange(impacts.shape[1]) // group_terms
        begins = np.arange(0, impacts.shape[1], group_terms)
        points = impacts * scale.astype(np.float32)
        # Rounding of the 32-bit points, centroids and sums below, far from tight.
        slack = 1e-6 * math.sqrt(group_terms) * float(points.max(initial=0.0))
        rows = np.arange(len(points))
        self.centroids, self.radii, self.spans, self.children = [], [], [], []
        open_ = [(0, len(rows), -1)]
        while open_:
            low, high, parent = open_.pop()
            node = len(self.spans)
            if parent >= 0:
                self.children[parent].append(node)
            own = points[rows[low:high]]
            centroid = own.mean(axis=0, dtype=np.float64).astype(np.float32)
            away = own - centroid
            squares = np.add.reduceat(away * away, begins, axis=1)
            self.centroids.append(centroid)
            self.radii.append(np.sqrt(squares.max(axis=0).astype(np.float64)) * (1 + 1e-5) + slack)
            self.spans.append((low, high))
            self.children.append([])
            if high - low > leaf and squares.any():
                # Two far points give the direction along which the rows are halved.
                one = away[np.argmax(squares.sum(axis=1))]
                other = away[np.argmin(away @ one)]
                order = np.argsort(away @ (one - other), kind="stable")
                rows[low:high] = rows[low:high][order]
                middle = (low + high) // 2
                open_ += [(low, middle, node), (middle, high, node)]
        self.rows = rows
        self.impacts = impacts[rows]
        self.centroids, self.radii = np.array(self.centroids), np.array(self.radii)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An upper bound of the score of any row below each node, for a query of weights over terms."""
        safe = np.where(self.scale[terms] > 0, self.scale[terms], 1.0)
        scaled = weights / safe
        groups, place = np.unique(self.group[terms], return_inverse=True)
        norms = np.sqrt(np.bincount(place, weights=scaled * scaled))
        return (self.centroids[:, terms].astype(np.float64) @ scaled + self.radii[:, groups] @ norms) * (1 + 1e-9) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, best: "Best") -> int:
        """Score the rows that can still enter ``best``; how many were scored."""
        bounds, scored = self.bounds(terms, weights).tolist(), 0
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= best.least():
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            low, high = self.spans[node]
            scores = self.impacts[low:high][:, terms].astype(np.int64) @ weights
            scored += high - low
            for row in np.flatnonzero((scores > 0) & (scores >= best.least())).tolist():
                best.add(int(scores[row]), int(self.rows[low + row]))
        return scored


class Best:
    """The highest scores of one query, ties to the smaller id; rows without an id come last."""

    def __init__(self, k: int):
        self.k, self.kept, self.ids = k, [], []

    def least(self) -> int:
        return self.kept[0][0] if len(self.kept) == self.k else 1

    def add(self, score: int, row: int) -> None:
        doc_id = self.ids[row]
        entry = (score, -math.inf if doc_id is None else -doc_id)
        if len(self.kept) < self.k:
            heapq.heappush(self.kept, entry)
        else:
            heapq.heappushpop(self.kept, entry)

    def result(self) -> list[tuple[int | None, int]]:
        return [(None if neg == -math.inf else -neg, score) for score, neg in self.kept]


def _search(shared, documents: int, occurrences: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids, weights = shared.value
        queries = [(terms[weights[terms] > 0], (times * weights[terms])[weights[terms] > 0]) for terms, times in items]
        best = [Best(top) for _ in queries]
        scale = np.sqrt(weights.astype(np.float64))
        for block_ids, impacts in _blocks(batches, len(weights), documents, occurrences):
            tree = BallTree(impacts, scale)
            for (terms, own), found in zip(queries, best):
                if len(terms):
                    found.ids = block_ids
                    tree.search(terms, own, found)
        rows = [(k, ids[k], d, s) for k, found in enumerate(best) for d, s in found.result()]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item", "item_id", "doc_id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int, documents: int, occurrences: int) -> Iterator[tuple[list, np.ndarray]]:
    """Dense blocks of impacts of bounded size, with the ids of their rows; rows without any term are left out."""
    size = max(LEAF, BLOCK_BYTES // (4 * max(width, 1)))
    ids: list[int | None] = []
    block = np.zeros((size, width), dtype=np.float32)
    for batch in batches:
        terms, times = batch.column("terms"), batch.column("times")
        ends = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        flat, counts = terms.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        n = np.repeat(batch.column("n").to_numpy(), np.diff(ends))
        values = impact(counts, n, documents, occurrences).astype(np.float32)
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends.tolist(), ends[1:].tolist()):
            if a == b:
                continue
            block[len(ids), flat[a:b]] = values[a:b]
            ids.append(doc_id)
            if len(ids) == size:
                yield ids, block
                ids, block = [], np.zeros((size, width), dtype=np.float32)
    if ids:
        yield ids, block[: len(ids)]


# ---- search -------------------------------------------------------------------------------------------

def _best_of(lists: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, merged in two steps so that no window grows with the number of tasks at once."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    slot = F.floor(F.spark_partition_id() / MERGED)
    near = Window.partitionBy("item", "slot").orderBy(*order)
    lists = lists.withColumn("slot", slot).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
    last = Window.partitionBy("item").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` rows of ``docs(doc_id, text)`` for each row of
    ``items(item_id, text)``; only scores above 0, equal scores by ascending id.

    Terms are runs of letters, digits and all characters outside ASCII, A-Z lower-cased. Null, empty and wordless texts
    have none: such documents are never found and not counted, such items find nothing. Every row is a document of its
    own, so a repeated one can be listed twice; rows without an id come last in a tie. Equal items are searched once; one
    item id with different texts gives a list per text. Other columns are not looked at; an empty table on either side
    gives an empty result. Items go to the tasks in parts of at most ``PART_BYTES`` of text on average (one longer item
    alone), the documents are read once per part; only their vectors over the part's terms are written, never shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical-search")
    asked = documents_of(items, "item_id", "text").filter("text IS NOT NULL").distinct()
    asked = asked.select(F.col("item_id").cast("long").alias("item_id"), "text")
    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES) or 1
    result = None
    for number in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == number).orderBy("item_id", "text")
        queries = Queries([(r["item_id"], r["text"]) for r in own.collect()])
        vocabulary = spark.sparkContext.broadcast(queries.terms)
        vectors = scratch.keep(texts.mapInArrow(_vectors(vocabulary), "doc_id long, n long, terms array<int>, times array<int>"))
        counted = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        held = np.zeros(len(queries.terms), dtype=np.int64)
        for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            held[row["term"]] = row["count"]
        weights = term_weights(held.tolist(), counted["documents"])
        shared = spark.sparkContext.broadcast((queries.items, queries.ids, weights))
        lists = vectors.mapInArrow(_search(shared, counted["documents"], counted["terms"], top), "item int, item_id long, doc_id long, score long")
        found = _best_of(lists, top)
        result = found if result is None else result.unionByName(found)
    return result
