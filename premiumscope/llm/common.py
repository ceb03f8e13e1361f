"""What the operators share: intermediate tables, Arrow batches of text, word and n-gram fingerprints."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.operators.scale import checkpoint_root

# Bytes of text that are turned into arrays at once: memory per task follows this, not the batch.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# All ASCII characters but letters and digits.
MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_random = np.random.default_rng(20240607)
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_VALUES = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Spark removes a statement's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BASE = 0x9E3779B97F4A7C13
BASE_INVERSE = pow(BASE, -1, 1 << 64)


# ---- tables -------------------------------------------------------------------------------------------

class Scratch:
    """Intermediate tables of one operator run, as Parquet below ``spark.checkpoint.dir``.

    Each cuts the lineage and survives lost executors; ``drop`` removes one that nothing reads any more.
    Tables that the returned DataFrame still reads are left to the owner of the checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Rows of text or of whole sets are long: fewer of them in an Arrow batch, unless the session says how many."""
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, "1000")


def documents_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: other columns of the input, whatever their names, never meet ours."""
    return df.select(*[F.col(f"`{name}`") for name in columns])


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker does, or until another owner asks for one: Spark hands
    its workers from stage to stage, and the tables of several operators would add up."""
    name = "_premiumscope_worker"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if held.get("owner") != owner:
        held["owner"], held["cache"] = owner, {}
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc: give what was freed back to the system
        if trim is not None:
            trim(0)
    return held["cache"]


# ---- batches of text ----------------------------------------------------------------------------------

def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches to slices of about ``SLICE_BYTES`` of text; one longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins; null is empty."""
    array = pc.fill_null(array, "").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int, base: int, key: str) -> np.ndarray:
    cache = worker_cache("words")
    if key not in cache or len(cache[key]) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        cache[key] = np.multiply.accumulate(steps)
    return cache[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts: byte spans, fingerprints, first word per text.
    With ``separators`` words are runs of letters and digits (and of all characters outside ASCII)."""

    def __init__(self, array: pa.Array, lower: bool = False, separators: bool = False):
        raw, offsets = text_bytes(array)
        self.raw, self.offsets = raw, offsets
        solid = ~(MARKS if separators else SPACE)[raw]
        before = np.empty(len(raw), dtype=bool)
        before[:1] = False
        before[1:] = solid[:-1]
        begins = offsets[:-1][offsets[:-1] < len(raw)]
        before[begins] = False
        after = np.empty(len(raw), dtype=bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        last = begins[begins > 0] - 1
        after[last] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._values = BYTE_VALUES[LOWER[raw]] if lower else BYTE_VALUES[raw]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit fingerprint per word: a polynomial over random byte values, by prefix sums."""
        n = len(self.raw)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self._values * _powers(n, BASE, "powers"), out=sums[1:])
        inverse = _powers(n + 1, BASE_INVERSE, "inverse")
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` words (runs that cross texts included; the caller skips them)."""
    size = max(0, len(words) - n + 1)
    total = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        total += words[j : j + size] * GRAM_VALUES[j]
    return mix(total)


def gram_range(first: np.ndarray, index: int, n: int) -> tuple[int, int]:
    """Where the runs of ``n`` words of one text begin and end in ``gram_hashes``."""
    start, stop = int(first[index]), int(first[index + 1])
    return start, max(start, stop - n + 1)


def long_array(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
