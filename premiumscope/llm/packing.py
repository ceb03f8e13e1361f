"""Packing documents into sequences of a fixed token capacity, balanced by attention cost.

Every document is coded, ended by one id, and cut into full sequences and one remainder. Remainders are packed
in blocks of consecutive rows of a partition: the cost of a document is ``tokens + quadratic * tokens**2``;
documents in descending order of cost go to the cheapest sequence that still has room. What fits nowhere whole
fills the free room of the block piece by piece, so only the last sequence of a block can have padding. Nothing
is shuffled: blocks are local, and their number of rows bounds memory.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import documents_of, text_slices
from premiumscope.llm.pretokens import coder, vocabulary_path

CAPACITY, END_ID = 1024, 0
# Attention cost of a token per token it looks at, relative to its linear cost.
QUADRATIC = 1 / CAPACITY
BLOCK_DOCS = 4096
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{name} long" for name in COLUMNS)


def _id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Sequences:
    """Sequences by load, with the cheapest of every range of loads in a tree of minima."""

    def __init__(self, count: int, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.by_load: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least = [(math.inf, -1, -1)] * (2 * self.size)
        self.by_load[0] = [(0.0, k) for k in range(count)]
        self._settle(0)

    def _settle(self, load: int) -> None:
        own = self.by_load[load]
        at = self.size + load
        self.least[at] = (*own[0], load) if own else (math.inf, -1, -1)
        while at > 1:
            at >>= 1
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def take(self, most: int) -> tuple[float, int, int] | None:
        """The cheapest sequence of a load of at most ``most`` (cost, number, load), taken out."""
        low, high, best = self.size, self.size + most + 1, (math.inf, -1, -1)
        while low < high:
            if low & 1:
                best = min(best, self.least[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.least[high])
            low, high = low >> 1, high >> 1
        if best[1] < 0:
            return None
        heapq.heappop(self.by_load[best[2]])
        self._settle(best[2])
        return best

    def put(self, cost: float, number: int, load: int) -> None:
        heapq.heappush(self.by_load[load], (cost, number))
        self._settle(load)


def pack_lengths(lengths: list[int], capacity: int, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """Pieces (item, start, length, offset) per sequence for items shorter than ``capacity``.

    The number of sequences is the least that can hold all tokens. Items go in descending order to the cheapest of all
    sequences that have room for them whole (ties to the first); only what none has room for is cut.
    """
    count = -(-sum(lengths) // capacity)
    sequences: list[list] = [[] for _ in range(count)]
    used = [0] * count
    open_ = _Sequences(count, capacity)
    rest = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        place = open_.take(capacity - size)
        if place is None:
            rest.append(item)
            continue
        cost, k, load = place
        sequences[k].append((item, 0, size, load))
        used[k] = load + size
        open_.put(cost + size + quadratic * size * size, k, used[k])
    room = sorted((k for k in range(count) if used[k] < capacity), key=lambda k: (capacity - used[k], k))
    for item in rest:
        start = 0
        while start < lengths[item]:
            k = room[-1]
            size = min(capacity - used[k], lengths[item] - start)
            sequences[k].append((item, start, size, used[k]))
            used[k] += size
            start += size
            if used[k] == capacity:
                room.pop()
    return sequences


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, quadratic: float = QUADRATIC, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its document is the end id alone. Repeated rows are packed once each; a null doc_id
    stays null. Other columns are not looked at. An empty table gives an empty result. ``sequence_id`` is
    unique within the result: partition number and count within it.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        encode = coder(path).ids
        end = _id_bytes([END_ID])
        rows: list[tuple] = []
        left: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of remainders

        def close() -> None:
            nonlocal sequence
            for pieces in pack_lengths([len(ids) // 4 for _, _, ids, _ in left], capacity, quadratic):
                for item, start, size, offset in pieces:
                    doc, before, ids, total = left[item]
                    code = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    rows.append((doc, before + start, size, code, total, sequence, offset))
                sequence += 1
            left.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(COLUMNS)
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=list(COLUMNS))

        for batch in text_slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = _id_bytes(encode(text or "")) + end
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    code = zlib.crc32(ids[4 * start : 4 * (start + capacity)])
                    rows.append((doc, start, capacity, code, total, sequence, 0))
                    sequence += 1
                if full < total:
                    left.append((doc, full, ids[4 * full :], total))
                if len(left) >= BLOCK_DOCS:
                    close()
            if rows:
                yield flush()
        close()
        yield flush()

    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(run, SCHEMA)
