"""N-gram Jaccard join: documents whose sets of word n-grams are similar, by a prefix filter and prefix trees.

1. Sets. Each text becomes its set of n-gram fingerprints in one global order: n-grams that many documents
   hold come last, all others by fingerprint. Documents with equal sets collapse to one node.
2. Prefix filter. Two sets that reach the similarity share an n-gram among the first
   ``n - ceil(t * n) + 1`` of each, so only those are shuffled, and n-grams of one node only go at once.
3. Contraction. Each node is compared with one pivot, the most central node of its n-grams. Verified links
   make components, so a large group of near copies is linked by about as many comparisons as it has nodes.
4. The rest, exactly. A node and another component that share enough prefix n-grams are compared with
   *every* member of that component; none is skipped, and pairs are counted before any set is moved.
5. Comparisons store the sets of a block of members in a prefix tree and walk it with each probe: partial
   overlaps are shared, and a subtree whose remaining length cannot reach the bound is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premiumscope.llm.common import (
    GRAM_VALUES,
    Scratch,
    Words,
    documents_of,
    gram_hashes,
    gram_range,
    mix,
    small_batches,
    text_slices,
)
from premiumscope.llm.components import components

N, SIMILARITY = 5, Fraction(3, 4)
# N-grams seen in more than this share of the documents are ordered last, the most frequent COMMON_MOST of them
# (8 bytes each are sent to the tasks). Any order gives the same links; this one keeps posting lists short.
COMMON_SHARE, COMMON_LEAST, COMMON_MOST, CHUNK_TOKENS = 1 / 20_000, 2, 1_000_000, 2_000_000
# Set elements in one block of a comparison: memory of a task.
BLOCK_TOKENS = 1_000_000
SALTS, SPARE = 64, 3


# ---- sets ---------------------------------------------------------------------------------------------

def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram fingerprints of all texts one after the other, and how many each text has.
    Fewer than n words give the whole sequence as one."""
    words = Words(batch.column("text"), lower=True)
    hashes, counts = words.hashes(), words.counts()
    grams = gram_hashes(hashes, n)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begins = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), dtype=np.uint64)
    for begin, size, count, word in zip(begins.tolist(), sizes.tolist(), counts.tolist(), words.first.tolist()):
        if count >= n:
            own = flat[begin : begin + size]
            own[:] = grams[word : word + size]
            own.sort()
        elif count:
            few = np.append(hashes[word : word + count], np.uint64(count))
            flat[begin] = mix((few * np.append(GRAM_VALUES[:count], GRAM_VALUES[-1])).sum(dtype=np.uint64, keepdims=True))[0]
    kept = np.ones(len(flat), dtype=bool)
    kept[1:] = flat[1:] != flat[:-1]
    filled = sizes > 0
    kept[begins[filled]] = True
    if filled.any():
        sizes[filled] = np.add.reduceat(kept, begins[filled], dtype=np.int64)
    return flat[kept], sizes


def _names(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each whole set."""
    first, second = np.zeros(len(sizes), dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64)
    filled = sizes > 0
    if filled.any():
        begins = (np.cumsum(sizes) - sizes)[filled]
        first[filled] = np.add.reduceat(mix(flat + GRAM_VALUES[-2]), begins)
        second[filled] = np.add.reduceat(mix(flat ^ GRAM_VALUES[-3]), begins)
    return mix(first ^ (second >> np.uint64(1))).view(np.int64), mix(second).view(np.int64)


def _signatures(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("node", pa.int64()),
                        ("check", pa.int64()), ("token", pa.int64()), ("seen", pa.int64())])

    def common(tokens: np.ndarray, docs: int) -> pa.RecordBatch:
        tokens.sort()  # in place: the chunk is the largest thing a task holds
        same = np.zeros(len(tokens) + 1, dtype=bool)
        np.equal(tokens[1:], tokens[:-1], out=same[1:-1])
        begins, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        seen = ends - begins + 1
        kept = seen >= max(COMMON_LEAST, docs * COMMON_SHARE)
        tokens, seen = tokens[begins[kept]].view(np.int64), seen[kept]
        blank = pa.nulls(len(tokens), pa.int64())
        return pa.record_batch([blank, blank, blank, blank, blank, pa.array(tokens), pa.array(seen)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, docs, held = np.empty(CHUNK_TOKENS, dtype=np.uint64), 0, 0
        for batch in text_slices(batches):
            flat, sizes = _sets(batch, n)
            node, check = _names(flat, sizes)
            blank = pa.nulls(len(sizes), pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("print"), pa.array(sizes), pa.array(node), pa.array(check), blank, blank],
                schema=schema)
            if held + len(flat) > CHUNK_TOKENS:
                yield common(chunk[:held], docs)
                docs, held = 0, 0
            if len(flat) > CHUNK_TOKENS:  # one very long text: its n-grams are distinct
                continue
            chunk[held : held + len(flat)] = flat
            docs, held = docs + len(sizes), held + len(flat)
        if held:
            yield common(chunk[:held], docs)

    return run


def _prefixes(n: int, t: Fraction, common: np.ndarray):
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("common", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies in one task are told once; the rest collapse later
        for batch in text_slices(batches):
            flat, sizes = _sets(batch, n)
            names = _names(flat, sizes)[0]
            fresh = np.zeros(len(sizes), dtype=bool)
            for i, name in enumerate(names.tolist()):
                fresh[i] = sizes[i] > 0 and name not in done
                done.add(name)
            if len(done) > 200_000:
                done.clear()
            flat = flat[np.repeat(fresh, sizes)]
            sizes, names = sizes[fresh], names[fresh]
            if not len(sizes):
                continue
            late = np.zeros(len(flat), dtype=bool)
            if len(common):
                late = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] == flat
            # Sorted sets stay sorted within (text, early or late).
            text = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(text * 2 + late, kind="stable")
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ahead = sizes - -(-sizes * t.numerator // t.denominator) + 1
            chosen = order[place < ahead[text]]
            yield pa.record_batch(
                [pa.array(flat[chosen].view(np.int64)), pa.array(np.repeat(names, ahead)),
                 pa.array(np.repeat(sizes, ahead).astype(np.int32)), pa.array(late[chosen])], schema=schema)

    return run


def _whole_sets(n: int):
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            flat, sizes = _sets(batch, n)
            ends = np.cumsum(sizes).tolist()
            own = [flat[end - size : end].tobytes() for end, size in zip(ends, sizes.tolist())]
            yield pa.record_batch([pa.array(_names(flat, sizes)[0]), pa.array(own, pa.binary())], schema=schema)

    return run


# ---- prefix trees -------------------------------------------------------------------------------------

class PrefixTree:
    """Sorted sets with their common beginnings stored once. A node: its run of elements, the smallest and
    largest set below it, the sets that end in it, its children."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        ranked = sorted(((s.astype(">u8").tobytes(), i) for i, (_, s) in enumerate(sets)))
        items = [sets[i] for _, i in ranked]
        self.roots: list[list] = []
        work = [(0, len(items), 0, self.roots)]
        while work:
            low, high, depth, siblings = work.pop()
            start = low
            while start < high:
                first = items[start][1]
                stop = start + 1
                while stop < high and items[stop][1][depth] == first[depth]:
                    stop += 1
                last = items[stop - 1][1]
                size = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:size] != last[depth:size])
                end = depth + int(differ[0]) if len(differ) else size
                sizes = [len(items[i][1]) for i in range(start, stop)]
                ended = [items[i][0] for i in range(start, stop) if len(items[i][1]) == end]
                node = [first[depth:end], min(sizes), max(sizes), ended, []]
                siblings.append(node)
                if len(ended) < stop - start:  # shorter sets sort first
                    work.append((start + len(ended), stop, end, node[4]))
                start = stop

    def linked(self, probe: np.ndarray, t: Fraction) -> Iterator[int]:
        """Names of the sets whose Jaccard similarity with ``probe`` is at least ``t``."""
        # overlap / (a + b - overlap) >= p / q  <=>  (p + q) * overlap >= p * (a + b)
        p, pq, size = t.numerator, t.numerator + t.denominator, len(probe)
        work = [(node, 0, 0, 0) for node in self.roots]
        while work:
            (run, least, most, ended, children), at, overlap, depth = work.pop()
            if pq * (overlap + min(size - at, most - depth)) < p * (size + least):
                continue
            end = int(np.searchsorted(probe, run[-1], side="right"))
            part = probe[at:end]
            if len(part):
                spot = np.minimum(np.searchsorted(part, run), len(part) - 1)
                overlap += int(np.count_nonzero(part[spot] == run))
            depth += len(run)
            if ended and pq * overlap >= p * (size + depth):
                yield from ended
            if children and pq * (overlap + min(size - end, most - depth)) >= p * (size + max(least, depth + 1)):
                work += [(child, end, overlap, depth) for child in children]


def _compare(t: Fraction):
    """Rows sorted by (block, probe or not): a tree of the members, then one link at most per probe."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, tree = None, [], None
        for batch in batches:
            found = []
            for name, probe, node, tokens in zip(*(batch.column(c).to_pylist() for c in ("block", "probe", "node", "tokens"))):
                if name != block:
                    block, members, tree = name, [], None
                own = np.frombuffer(tokens, dtype=np.uint64)
                if not probe:
                    members.append((node, own))
                    continue
                if tree is None:
                    tree = PrefixTree(members)
                other = next(tree.linked(own, t), None)
                if other is not None:
                    found.append((node, other))
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()),
                                   pa.array([b for _, b in found], pa.int64())], schema=schema)

    return run


def _verified(pairs: DataFrame, members: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Links (a, b) between probes of ``pairs(node, n, target)`` and members of ``members(target, node, n)``.

    Both sides of a target are dealt to blocks of bounded size, and every block of probes meets every block
    of members, so a large target is spread over many tasks. One link per probe and block is enough: the
    members of a target are linked with each other already.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("target").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias(name))

    sizes = blocks(pairs, "probes").join(blocks(members, "parts"), "target")
    spread = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = members.join(sizes, "target").withColumn("part", spread("parts")).withColumn("slot", every("probes"))
    right = pairs.join(sizes, "target").withColumn("slot", spread("probes")).withColumn("part", every("parts"))
    rows = left.select("node", "target", "part", "slot", F.lit(False).alias("probe")).unionByName(
        right.select("node", "target", "part", "slot", F.lit(True).alias("probe")))
    block = F.concat_ws(":", "target", "part", "slot").alias("block")
    loaded = rows.join(sets, "node").select(block, "probe", "node", "tokens")
    return loaded.repartition("block").sortWithinPartitions("block", "probe").mapInArrow(_compare(t), "a long, b long")


# ---- the join -----------------------------------------------------------------------------------------

def _at_least(t: Fraction, a: Column, b: Column) -> Column:
    """The overlap that sets of ``a`` and ``b`` elements need."""
    p, pq = t.numerator, t.numerator + t.denominator
    return F.ceil((a + b) * F.lit(p) / F.lit(pq) - F.lit(1e-9))


def _shared_least(t: Fraction, a: Column, b: Column) -> Column:
    """How many prefix n-grams sets of these sizes have in common at least if they are similar."""
    larger = F.greatest(a, b)
    kept = F.ceil(larger * F.lit(t.numerator) / F.lit(t.denominator) - F.lit(1e-9))
    return F.greatest(F.lit(1), _at_least(t, a, b) - kept + 1)


def _shared_least_within(t: Fraction, a: Column, low: Column, high: Column) -> Column:
    """As ``_shared_least``, for every size from ``low`` to ``high`` on the other side.

    Up to ``a`` it rises with the size, so ``low`` decides. Above, its two ceilings make it go up and down by one
    while it falls, and ``p (q a - p b) / (q (p + q))``, rounded down, plus one is below it and never rises.
    """
    p, q = t.numerator, t.denominator
    falling = F.floor((a * q - high * p) * F.lit(p) / F.lit(q * (p + q)) + F.lit(1e-9)) + 1
    first = _shared_least(t, a, low)
    return F.when((low == high) | (high <= a), first).otherwise(F.greatest(F.lit(1), F.least(first, falling)))


def ngram_join(docs: DataFrame, n: int = N, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, and to tell rows of one id apart ``print`` (hash
    of the text), ``node`` (name of the set) and ``component`` (name of the group of linked sets, null without one).

    ``component_id`` is the smallest doc_id reachable over links of Jaccard similarity ``similarity`` or more.
    A null or wordless text has an empty set and is linked with nothing. A row without doc_id keeps its place
    and takes part like any other; a component without any doc_id has a null component_id. Repeated rows and
    repeated ids stay, each with its row. Other columns of ``docs`` are not looked at. An empty table gives
    an empty result. N-grams are 64-bit fingerprints of the words.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    small_batches(docs.sparkSession)
    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = "doc_id long, print long, n long, node long, check long, token long, seen long"
    signed = scratch.keep(texts.withColumn("print", F.xxhash64("text")).mapInArrow(_signatures(n), kind))
    rows = signed.filter("node IS NOT NULL")
    sets_of = rows.filter("n > 0")
    total = rows.count()
    frequent = (signed.filter("node IS NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
                .filter(F.col("seen") >= total * COMMON_SHARE)
                .orderBy(F.desc("seen"), "token").limit(COMMON_MOST).select("token"))
    common = np.sort(frequent.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))

    first = texts.mapInArrow(_prefixes(n, similarity, common), "token long, node long, n int, common boolean")
    key = F.col("token") + F.when(F.col("common"), F.pmod(F.col("node"), F.lit(SALTS))).otherwise(0)
    same = Window.partitionBy("key")
    shared = first.withColumn("key", key).withColumns({"low": F.min("node").over(same), "high": F.max("node").over(same)})
    shared = scratch.keep(shared.filter("common OR low <> high").select("token", "node", "n").distinct())

    nodes = scratch.keep(shared.select("node", "n").distinct())

    def sets(wanted: DataFrame) -> DataFrame:
        """Sets of the wanted nodes, from the text of one document for each."""
        named = sets_of.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        named = scratch.keep(named)
        chosen = scratch.keep(named.filter("doc_id IS NOT NULL").select("doc_id").distinct())
        kind = "node long, tokens binary"
        found = texts.join(chosen, "doc_id", "left_semi").mapInArrow(_whole_sets(n), kind)
        nameless = named.filter("doc_id IS NULL").select("node")
        bare = texts.filter("doc_id IS NULL").mapInArrow(_whole_sets(n), kind).join(nameless, "node", "left_semi")
        return scratch.keep(found.union(bare))

    # Contraction: each node against the most central node of the n-grams it shares.
    central = shared.groupBy("node").agg((F.count("*") / (F.max("n") * (1 - float(similarity)) + 1)).alias("share"))
    pivots = (shared.join(central, "node").groupBy("token")
              .agg(F.min(F.struct(-F.col("share"), F.col("node"), F.col("n"))).alias("p"))
              .select("token", F.col("p.node").alias("target"), F.col("p.n").alias("size")))
    fits = _at_least(similarity, F.col("n"), F.col("size")) <= F.least("n", "size")
    nearest = (shared.join(pivots, "token").filter((F.col("node") != F.col("target")) & fits)
               .groupBy("node", "n", "target", "size").count()
               .groupBy("node", "n").agg(F.max(F.struct("count", "target", "size")).alias("p")))
    nearest = nearest.select("node", "n", F.col("p.target").alias("target"), F.col("p.size").alias("size"))
    partner = shared.select("token", F.col("node").alias("target"))
    edges = (nearest.join(shared.select("node", "token"), "node").join(partner, ["token", "target"])
             .groupBy("node", "n", "target", "size").count()
             .filter(F.col("count") >= _shared_least(similarity, F.col("n"), F.col("size"))))
    edges = scratch.keep(edges.drop("count"))
    own = sets(edges.select("node").union(edges.select("target")).distinct())
    members = edges.select("target", F.col("target").alias("node"), F.col("size").alias("n")).distinct()
    stars = scratch.keep(_verified(edges.drop("size"), members, own, similarity))
    scratch.drop(own)
    merged = scratch.keep(components(stars, scratch))

    # Every remaining pair of components that share prefix n-grams.
    placed = nodes.join(merged, "node", "left").select("node", "n", F.coalesce("component", "node").alias("target"))
    placed = scratch.keep(placed)
    groups = placed.groupBy("target").agg(F.count("*").alias("nodes"), F.min("n").alias("low"), F.max("n").alias("high"))
    held_all = scratch.keep(shared.join(placed.select("node", "target"), "node").join(groups, "target"))
    scratch.drop(shared, nodes, edges)
    mixed = held_all.groupBy("token").agg(F.min("target").alias("x"), F.max("target").alias("y"), F.count("*").alias("times"))
    held = held_all.join(mixed.filter("x <> y").select("token", "times"), "token")
    # A pair cannot share more prefix n-grams than either side has in common with others at all.
    own_most = held.groupBy("node", "target").agg(F.count("*").alias("shares"))
    most = own_most.groupBy("target").agg(F.max("shares").alias("most"))
    held = held.join(own_most.drop("target"), "node").join(most, "target")
    # Of ``shares`` n-grams of a node, in order of frequency, at least ``SPARE + 1`` of any ``least`` are among the
    # first ``shares - least + 1 + SPARE``: the most frequent ones need not be joined.
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("times", "token")))
    carried = ("target", "nodes", "low", "high", "most")
    others = held.select("token", *[F.col(c).alias(f"{c}_") for c in carried]).distinct()
    a, low, high = F.col("n"), F.col("low_"), F.col("high_")
    t = float(similarity)
    low = F.greatest(low, F.ceil(a * t - 1e-9))
    high = F.least(high, F.floor(a / t + 1e-9))
    least = _shared_least_within(similarity, a, low, high)
    later = F.struct("nodes", "target") < F.struct("nodes_", "target_")
    possible = (low <= high) & (F.least("shares", "most_") >= least)
    early = F.col("place") <= F.col("shares") - least + 1 + SPARE
    pairs = (held.join(others, "token").filter(later & possible & early)
             .groupBy("node", "n", "target_", F.least(least, F.lit(SPARE + 1)).alias("least")).count().filter("count >= least")
             .select("node", "n", F.col("target_").alias("target")))
    pairs = scratch.keep(pairs)
    members = placed.join(pairs.select("target").distinct(), "target", "left_semi").select("target", "node", "n")
    own = sets(pairs.select("node").union(members.select("node")).distinct())
    links = scratch.keep(_verified(pairs, members, own, similarity))
    joined = components(stars.union(links), scratch)

    firsts = sets_of.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    labelled = firsts.join(joined, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    labelled = scratch.keep(labelled)
    lowest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = scratch.keep(labelled.join(lowest, "component").select("node", "component", "component_id"))
    scratch.drop(own, held_all, stars, merged, placed, pairs, links, labelled)
    result = rows.join(by_node, "node", "left").withColumn("linked", F.col("n") > 0)
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "print", "node", F.when(F.col("linked"), F.col("component")).alias("component"))
