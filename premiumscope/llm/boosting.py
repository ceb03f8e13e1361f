"""Gradient-boosted trees (logistic loss) for models that score spans inside tasks, fitted on tables of any size.

Every row counts. Columns are put in bins once; each level of a tree is one pass over the binned rows that adds up gradients by
node, column and bin, in whole numbers, so the order of the additions does not matter. Only those sums reach the driver; their
number follows nodes, columns and bins, not rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import Scratch

# Bounds per column and part, the steps values are rounded up to for them, and the unit of the added gradients.
BINS, GRID, UNIT = 16, 1024, 1 << 24


def _bounds(rows: DataFrame) -> list[np.ndarray]:
    """Bin bounds of each column: the quantiles over all rows of each part, so that a frequent part does not set them alone."""
    cells = (rows.select("part", "n", F.posexplode("row").alias("column", "value"))
             .groupBy("part", "column", F.ceil(F.col("value") * GRID).alias("cell")).agg(F.sum("n").alias("n")).collect())
    counts: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for r in cells:
        counts[r["column"]][r["part"]].append((r["cell"], r["n"]))
    bounds = []
    for column in range(len(counts)):
        chosen = set()
        for held in counts[column].values():
            held.sort()
            whole, upto = sum(n for _, n in held), 0
            for cell, n in held:
                if (upto + n) * BINS // whole > upto * BINS // whole:
                    chosen.add(cell)
                upto += n
        bounds.append(np.array(sorted(chosen)) / GRID)
    return bounds


def _binned(rows: DataFrame, bounds: list[np.ndarray]) -> DataFrame:
    """How many rows have the same bins (two bytes a column) and label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(bounds))
            bins = np.stack([np.searchsorted(b, x[:, i]) for i, b in enumerate(bounds)], axis=1).astype("<u2")
            yield pa.record_batch([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("label"), batch.column("n")],
                                  names=["bins", "label", "n"])

    binned = rows.select("row", "label", "n").mapInArrow(run, "bins binary, label int, n long")
    return binned.groupBy("bins", "label").agg(F.sum("n").alias("n"))


def _answers(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """What the leaves of a tree over bins hold for each row."""
    if len(tree) == 1:
        return np.full(len(bins), tree[0], dtype=float)
    return np.where(bins[:, tree[0]] <= tree[1], _answers(tree[2], bins), _answers(tree[3], bins))


def _sums(binned: DataFrame, sizes: list[int], start: float, trees: list, places: tuple, nodes: int, rate: float) -> np.ndarray:
    """Gradients, second derivatives and rows by open node, column and bin; ``places`` is a tree whose leaves hold the number of
    the open node, or -1."""
    columns, width = len(sizes), max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, nodes * columns * width))
        for batch in batches:
            raw = b"".join(batch.column("bins").to_pylist())
            bins = np.frombuffer(raw, "<u2").reshape(batch.num_rows, columns).astype(np.int64)
            y, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "n"))
            node = _answers(places, bins).astype(np.int64)
            total = np.full(len(y), start)
            for tree in trees:
                total += _answers(tree, bins)
            p = 1 / (1 + np.exp(-total))
            here = node >= 0
            slots = ((node[:, None] * columns + np.arange(columns)) * width + bins)[here].ravel()
            for i, value in enumerate((np.rint(UNIT * rate * (y - p)) * n, np.rint(UNIT * p * (1 - p)) * n, n)):
                sums[i] += np.bincount(slots, np.repeat(value[here], columns), minlength=sums.shape[1])
        slot = np.flatnonzero(sums[2])
        yield pa.record_batch([pa.array(slot, pa.int64()), *[pa.array(s[slot].astype(np.int64)) for s in sums]],
                              names=["slot", "g", "h", "n"])

    added = binned.mapInArrow(run, "slot long, g long, h long, n long").groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    sums = np.zeros((3, nodes * columns * width))
    for r in added.collect():
        sums[:, r["slot"]] = r["g"] / UNIT, r["h"] / UNIT, r["n"]
    return sums.reshape(3, nodes, columns, width)


def _split(sums: np.ndarray, least: int) -> tuple | None:
    """The best (column, bin, sums of the left side, sums of the right side) of a node, from its sums by column and bin."""
    left = sums.cumsum(axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[0] ** 2 / (whole[1] + 1)
    gain[(left[2] < least) | (right[2] < least)] = 0
    column, place = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[column, place] <= 1e-9:
        return None
    return int(column), int(place), left[:, column, place], right[:, column, place]


def _shape(node: dict, leaf: str) -> tuple:
    if "split" not in node:
        return (node[leaf],)
    column, place, left, right = node["split"]
    return (column, place, _shape(left, leaf), _shape(right, leaf))


def _grow(binned: DataFrame, sizes: list[int], start: float, trees: list, depth: int, rate: float, least: int) -> tuple:
    """A tree as nested tuples: (column, bin, left, right) or (value,). One pass over the rows per level."""
    root = {"value": 0.0, "place": 0}
    level = [root]
    for step in range(depth):
        sums = _sums(binned, sizes, start, trees, _shape(root, "place"), len(level), rate)
        following = []
        for node in level:
            best = _split(sums[:, node["place"]], least)
            node["place"] = -1
            if best is None:
                continue
            column, place, *sides = best
            children = [{"value": float(g / (h + 1)), "place": -1} for g, h, _ in sides]
            node["split"] = (column, place, *children)
            for child, (_, _, n) in zip(children, sides):
                if step + 1 < depth and n >= 2 * least:
                    child["place"] = len(following)
                    following.append(child)
        level = following
        if not level:
            break
    return _shape(root, "value")


def _with_bounds(tree: tuple, bounds: list[np.ndarray]) -> tuple:
    """The tree over values instead of bins: a row is in a bin up to some bound if its value is at most that bound."""
    if len(tree) == 1:
        return tree
    column, place, left, right = tree
    return (column, float(bounds[column][place]), _with_bounds(left, bounds), _with_bounds(right, bounds))


def _answer(tree: tuple, row: list[float]) -> float:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def fit_boosted(rows: DataFrame, rounds: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5) -> tuple[float, list]:
    """Start value and trees; the score of a row is the sigmoid of their sum.

    ``rows`` has part (int), row (array<double>, equally long, not null), label (0 or 1) and n (how often it occurs); all of
    them are learned from. Equal rows may come together or apart. Without rows there are no trees.
    """
    right, n = rows.agg(F.sum(F.col("label") * F.col("n")), F.sum("n")).first()
    if not n:
        return 0.0, []
    share = np.clip(right / n, 1e-3, 1 - 1e-3)
    start, trees = float(np.log(share / (1 - share))), []
    scratch = Scratch(rows.sparkSession, "boosting")
    bounds = _bounds(rows)
    binned = scratch.keep(_binned(rows, bounds))
    for _ in range(rounds):
        tree = _grow(binned, [len(b) + 1 for b in bounds], start, trees, depth, rate, least)
        if len(tree) == 1:
            break
        trees.append(tree)
    scratch.drop(binned)
    return start, [_with_bounds(tree, bounds) for tree in trees]


def score(model: tuple[float, list], row: list[float]) -> float:
    start, trees = model
    total = start + sum(_answer(tree, row) for tree in trees)
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))
