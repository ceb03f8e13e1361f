"""Embedding near-duplicates by spherical-cap filters from a structured random product code.

A vector is rotated at random and cut into four blocks; each block has a small random code book. A filter is one
code word per block, its direction their concatenation, so ``words ** 4`` directions need only four tables.
Each vector is list-decoded to all filters whose cap it lies in: sums over two blocks are sorted, and for every
sum over the other two the exceeding ones are found by bisection. Vectors are joined on their filters within a
label, and every pair that meets is verified by its cosine in double precision. A pair is counted at the
smallest filter it shares, so no pair is written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import Scratch, documents_of
from premiumscope.llm.components import components

BLOCKS, SEED = 4, 93
# Two vectors whose cosine is just the one asked for share no filter in at most this share of the cases. Each code
# tries it on random pairs: from FILTERS filters a vector on, the number grows by half until it holds.
MISSED, PAIRS, FILTERS = 0.005, 1000, 32
# Rows of one side of a comparison: memory of a task.
BLOCK_ROWS = 1024


class ProductCode:
    """``count`` filters per vector are expected, and a vector always takes three quarters of it, its best ones."""

    def __init__(self, dimensions: int, words: int, least: float = 0.93):
        rng = np.random.default_rng([SEED, dimensions, words])
        self.padded = -(-dimensions // BLOCKS) * BLOCKS
        if self.padded == BLOCKS:  # blocks of one dimension have two directions only
            words = 2
        self.words = words
        self.rotation = np.linalg.qr(rng.standard_normal((self.padded, self.padded)))[0][:dimensions]
        books = rng.standard_normal((BLOCKS, words, self.padded // BLOCKS))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True)
        if words == 2:
            self.books = np.tile([[1.0], [-1.0]], (BLOCKS, 1, 1))
        self._take(FILTERS)
        while self.least < words**BLOCKS and self._misses(dimensions, least):
            self._take(self.count * 3 // 2)

    def _take(self, count: int) -> None:
        total = self.words**BLOCKS
        self.count, self.least = count, min(count * 3 // 4, total)
        self.bound = NormalDist().inv_cdf(1 - min(0.5, count / total)) * (BLOCKS / self.padded) ** 0.5

    def _misses(self, dimensions: int, cosine: float) -> bool:
        """Whether more than ``MISSED`` of the random pairs of this cosine share no filter."""
        rng, missed = np.random.default_rng([SEED, dimensions]), 0
        for _ in range(PAIRS):
            a, b = np.linalg.qr(rng.standard_normal((dimensions, 2)))[0].T
            near = cosine * a + max(0.0, 1 - cosine**2) ** 0.5 * b
            missed += not len(np.intersect1d(self.filters(a), self.filters(near), assume_unique=True))
            if missed > MISSED * PAIRS:
                return True
        return False

    def filters(self, unit: np.ndarray) -> np.ndarray:
        """Sorted numbers of all filters whose cap holds the vector; at least the ``least`` best."""
        parts = (unit @ self.rotation).reshape(BLOCKS, -1)
        scores = np.einsum("bwd,bd->bw", self.books, parts)
        first = (scores[0][:, None] + scores[1]).ravel()
        second = (scores[2][:, None] + scores[3]).ravel()
        order = np.argsort(-second)
        falling = -second[order]
        bound = self.bound
        while True:
            reach = np.searchsorted(falling, first - bound, side="right")
            if reach.sum() >= self.least:
                break
            bound -= 0.05
        left = np.repeat(np.arange(len(first)), reach)
        right = order[np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach)]
        found = left * len(second) + right
        if bound < self.bound:  # too few exceed the bound: the best ones
            total = first[left] + second[right]
            found = found[np.argsort(-total, kind="stable")[: self.least]]
        return np.sort(found)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, sizes = [], []
        for row, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
            values = np.array(row, dtype=np.float64) if row and label is not None and None not in row else None
            # Scaled by the largest component first, so that very large and very small vectors keep their angle.
            top = np.abs(values).max() if values is not None and np.isfinite(values).all() else 0
            if top:
                scaled = values / top
                vectors.append((scaled / np.linalg.norm(scaled)).tobytes())
            else:
                vectors.append(None)
            sizes.append(len(row or ()))
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()),
                               pa.array(vectors, pa.binary())], names=["vec_id", "label", "size", "unit"])


@lru_cache(maxsize=64)
def _code(dimensions: int, words: int, least: float) -> ProductCode:
    return ProductCode(dimensions, words, least)


def _decode(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for size, unit in zip(batch.column("size").to_pylist(), batch.column("unit").to_pylist()):
                lists.append(_code(size, words, least).filters(np.frombuffer(unit)).tolist())
            yield pa.record_batch([batch.column("node"), pa.array(lists, pa.list_(pa.int64()))], names=["node", "filters"])

    return run


def _meet(least: float):
    """Rows sorted by (bucket, side): how many copies each row newly links to, and its root in the bucket."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def bucket(rows: list[tuple]) -> tuple[list, np.ndarray, np.ndarray]:
        left = [r for r in rows if r[0] == 0]
        right = [r for r in rows if r[0] == 1]
        same = not right  # a block against itself
        both = left + right
        nodes = np.array([r[1] for r in both])
        units = np.stack([np.frombuffer(r[2]) for r in both])
        linked = units @ units.T >= least
        np.fill_diagonal(linked, False)
        if not same:
            cut = len(left)
            linked[:cut, :cut] = False
            linked[cut:, cut:] = False
        own = both[0][5]
        earlier = [[g for g in r[4] if g < own] for r in both]
        names = {g: k for k, g in enumerate(sorted({g for e in earlier for g in e}))}
        held = np.zeros((len(both), len(names)), dtype=np.float32)
        for i, e in enumerate(earlier):
            held[i, [names[g] for g in e]] = 1
        fresh = linked & ~(held @ held.T > 0) if names else linked
        copies = np.array([r[3] for r in both], dtype=np.int64)
        root = np.arange(len(both))
        while True:
            low = np.where(linked, root[None, :], len(both)).min(axis=1, initial=len(both))
            following = np.minimum(root, low)
            following = following[following]
            if (following == root).all():
                break
            root = following
        return nodes, fresh @ copies, nodes[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            nodes, links, roots = bucket(rows)
            kept = (links > 0) | (roots != nodes)
            return pa.record_batch([pa.array(nodes[kept]), pa.array(links[kept]), pa.array(roots[kept])], schema=schema)

        name, rows = None, []
        for batch in batches:
            fields = ("bucket", "side", "node", "unit", "copies", "filters", "filter")
            for key, *row in zip(*(batch.column(c).to_pylist() for c in fields)):
                if key != name and len(rows) > 1:
                    yield out(rows)
                if key != name:
                    name, rows = key, []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield out(rows)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding, label)``.

    Rows are compared only with rows of the same label and length. A vector that is null, empty, zero or holds a
    null or non-finite component, and one without label, links with nothing and is its own component. Equal
    vectors are compared once and count as links of each other. A row without vec_id takes part; it is never the
    smallest id. Repeated ids stay as rows; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "cap-filters")
    chosen = documents_of(vectors, "vec_id", "embedding", "label")
    chosen = chosen.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                           F.col("label").cast("string").alias("label"))
    rows = chosen.mapInArrow(_clean, "vec_id long, label string, size int, unit binary")
    # Equal vectors of a label are one node.
    named = F.xxhash64("label", "size", "unit", F.lit(1))
    rows = scratch.keep(rows.withColumn("node", F.when(F.col("unit").isNotNull(), named)))
    valid = rows.filter("node IS NOT NULL")
    nodes = valid.groupBy("node").agg(F.first("label").alias("label"), F.first("size").alias("size"), F.first("unit").alias("unit"),
                                      F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    nodes = scratch.keep(nodes)
    total = nodes.count()
    words = next((w for w in (16, 32, 64) if w**BLOCKS >= total), 128)

    decoded = scratch.keep(nodes.mapInArrow(_decode(words, least), "node long, filters array<long>"))
    placed = decoded.join(nodes.select("node", "label", "size"), "node").select(
        "node", "label", "size", F.explode("filters").alias("filter"))
    sizes = placed.groupBy("label", "size", "filter").count().filter("count > 1").withColumn(
        "parts", F.ceil(F.col("count") / BLOCK_ROWS).cast("int")).drop("count")
    placed = placed.join(sizes, ["label", "size", "filter"])
    # A large bucket is dealt to parts, and each part meets each other part and itself.
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("part", part).withColumn("other", other)
    bucket = F.concat_ws(":", "label", "size", "filter", F.least("part", "other"), F.greatest("part", "other"))
    placed = placed.select("node", "filter", bucket.alias("bucket"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    payload = decoded.join(nodes.select("node", "unit", "copies"), "node")
    met = (placed.join(payload, "node").repartition("bucket").sortWithinPartitions("bucket", "side")
           .mapInArrow(_meet(least), "node long, links long, root long"))
    met = scratch.keep(met)

    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(met.filter("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    labelled = (nodes.select("node", "copies", "vec_id").join(links, "node", "left").join(joined, "node", "left")
                .select("node", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "node").alias("component")))
    labelled = scratch.keep(labelled)
    lowest = labelled.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    by_node = scratch.keep(labelled.join(lowest, "component").select("node", "n_links", "component_id"))
    scratch.drop(decoded, met, labelled, nodes)
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    result = rows.select("vec_id", "node").join(by_node, "node", "left")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))
