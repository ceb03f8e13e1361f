"""Importance resampling towards a target distribution, with the text cut to lines that are counted once.

Features are runs of one to three words; a text's model is a count per bucket of their checksums. A newline separates
words, so lines never cut one, and a run either lies in one line or crosses a line's end. Runs inside lines are counted
once per distinct line and multiplied by the line's occurrences; runs that cross are added separately, from the two
first and two last words of each line, which is all they can reach. Document weights use the same two parts, with the
lines of a slice of documents made distinct.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import LOWER, Scratch, Words, documents_of, text_slices
from premiumscope.llm.resampling import _kth_largest

BUCKETS, RUN = 10_000, 3
LEAST_WORDS, KEEP_PERCENT, SEED = 20, 5, 42
# Words longer than this many bytes go to the checksum of the library one by one, shorter ones byte by byte together.
SHORT = 48
_CRC = np.array([~crc32(bytes([b]), 0xFFFFFFFF) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


# ---- features -----------------------------------------------------------------------------------------

class Features:
    """Words of a slice of texts as bytes, and the bucket of runs of them."""

    def __init__(self, array: pa.Array):
        self.words = Words(array, separators=True)
        self.raw = LOWER[self.words.raw]
        self.sizes = self.words.ends - self.words.starts

    def _extend(self, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Checksum registers after the bytes of ``words`` are appended to what each has seen."""
        order = np.argsort(-self.sizes[words], kind="stable")
        sizes, starts, state = self.sizes[words][order], self.words.starts[words][order], state[order]
        longer = int(np.searchsorted(-sizes, -SHORT, side="left"))
        for i in range(longer):
            piece = self.raw[starts[i] : starts[i] + sizes[i]].tobytes()
            state[i] = ~crc32(piece, int(~state[i])) & 0xFFFFFFFF
        low, high = longer, len(sizes)
        for step in range(int(sizes[low]) if low < high else 0):
            high = low + int(np.searchsorted(-sizes[low:], -step, side="left"))
            part = state[low:high]
            state[low:high] = _CRC[(part ^ self.raw[starts[low:high] + step]) & np.uint32(255)] ^ (part >> np.uint32(8))
        result = np.empty_like(state)
        result[order] = state
        return result

    def runs(self, sequence: np.ndarray, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first place, bucket) of all runs of n words of ``sequence`` whose words share one ``unit``."""
        state = np.full(len(sequence), 0xFFFFFFFF, dtype=np.uint32)
        first = np.arange(len(sequence))
        for n in range(1, RUN + 1):
            if n > 1:
                first = first[first + n - 1 < len(sequence)]
                first = first[unit[first] == unit[first + n - 1]]
                state = state[first] if n == 2 else state[np.searchsorted(held, first)]
                state = _CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = self._extend(state, sequence[first + n - 1])
            held = first
            yield n, first, (~state % np.uint32(BUCKETS)).astype(np.int64)

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and row of every run inside a row."""
        row = np.repeat(np.arange(len(self.words.offsets) - 1), self.words.counts())
        found = [(bucket, row[first]) for _, first, bucket in self.runs(np.arange(len(row)), row)]
        return tuple(np.concatenate(part) for part in zip(*found))

    def crossing(self, lines: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text of every run that crosses a line's end; ``lines`` are the rows that follow each other in
        the texts, ``text`` the text of each."""
        counts = self.words.counts()[lines]
        lines, text, counts = lines[counts > 0], text[counts > 0], counts[counts > 0]
        edge = np.minimum(counts, 2 * (RUN - 1))
        place = np.arange(edge.sum()) - np.repeat(np.cumsum(edge) - edge, edge)
        total = np.repeat(counts, edge)
        # The first two and the last two words of a line; all of a short one.
        place = np.where(place < RUN - 1, place, total - np.repeat(edge, edge) + place)
        sequence = np.repeat(self.words.first[lines], edge) + place
        occurrence, owner = np.repeat(np.arange(len(lines)), edge), np.repeat(text, edge)
        found = []
        for n, first, bucket in self.runs(sequence, owner):
            across = occurrence[first] != occurrence[first + n - 1]
            found.append((bucket[across], owner[first[across]]))
        return tuple(np.concatenate(part) for part in zip(*found))


class Lines:
    """Distinct lines of some texts (A-Z lower-cased), and which of them follow each other in each text."""

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        order, sizes = [], []
        for text in texts:
            own = (text or "").encode().lower().split(b"\n")
            order.extend(number.setdefault(line, len(number)) for line in own)
            sizes.append(len(own))
        self.lines = pa.array(list(number), pa.binary()).cast(pa.string())
        self.order = np.array(order, dtype=np.int64)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.features = Features(self.lines)

    def crossing(self) -> tuple[np.ndarray, np.ndarray]:
        return self.features.crossing(self.order, self.text)


# ---- counts -------------------------------------------------------------------------------------------

def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lines of each slice with their occurrences, and the counts of the runs that cross lines."""
    crossed = np.zeros(BUCKETS, dtype=np.int64)
    for batch in text_slices(batches):
        cut = Lines(batch.column("text").to_pylist())
        crossed += np.bincount(cut.crossing()[0], minlength=BUCKETS)
        times = np.bincount(cut.order, minlength=len(cut.lines))
        worded = cut.features.words.counts() > 0
        lines = cut.lines.filter(pa.array(worded))
        yield pa.record_batch([lines, pa.nulls(len(lines), pa.int32()), pa.array(times[worded])], names=["line", "bucket", "times"])
    held = np.flatnonzero(crossed)
    yield pa.record_batch([pa.nulls(len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(crossed[held])],
                          names=["line", "bucket", "times"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per bucket: every distinct line's runs times its occurrences, and the runs counted before."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in text_slices(batches, "line"):
        times = batch.column("times").to_numpy()
        bucket, row = Features(batch.column("line")).inside()
        _add(total, bucket, times[row])
        counted = batch.column("bucket")
        _add(total, counted.drop_null().to_numpy().astype(np.int64), times[np.asarray(counted.is_valid())])
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "times"])


def _add(total: np.ndarray, bucket: np.ndarray, times: np.ndarray) -> None:
    """Whole numbers stay whole: those above one are few."""
    total += np.bincount(bucket[times == 1], minlength=BUCKETS)
    np.add.at(total, bucket[times != 1], times[times != 1])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket of all rows of ``texts(text)``; at most ``BUCKETS`` sums reach the driver.

    Lines are combined in the tasks, then by Spark before and after one shuffle of distinct lines, so a line that
    many documents share moves once per task.
    """
    parts = texts.mapInArrow(_cut, "line string, bucket int, times long")
    lines = parts.groupBy("line", "bucket").agg(F.sum("times").alias("times"))
    counted = lines.mapInArrow(_count, "bucket int, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    total = np.zeros(BUCKETS, dtype=np.int64)
    for row in counted.collect():
        total[row["bucket"]] = row["times"]
    return total


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed models per bucket, rounded down."""
    t_all, s_all = float(target.sum() + BUCKETS), float(raw.sum() + BUCKETS)
    pairs = zip(target.tolist(), raw.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for t, s in pairs], dtype=np.int64)


# ---- scores -------------------------------------------------------------------------------------------

def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number drawn by the id, rounded down; all rows without an id share one."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            cut = Lines(batch.column("text").to_pylist())
            bucket, line = cut.features.inside()
            sums, sizes = np.zeros(len(cut.lines), dtype=np.int64), np.bincount(line, minlength=len(cut.lines))
            np.add.at(sums, line, gain[bucket])
            weight, features = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(weight, cut.text, sums[cut.order])
            np.add.at(features, cut.text, sizes[cut.order])
            bucket, text = cut.crossing()
            np.add.at(weight, text, gain[bucket])
            np.add.at(features, text, 1)
            drawn = np.array([noise(d, seed) for d in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(features), pa.array(weight), pa.array(weight + drawn)],
                                  names=["doc_id", "n_features", "weight", "score"])

    return run


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with their rank by descending score, then ascending doc_id: a range sort written once, then the
    sizes of its parts give the offsets. Only one size per part reaches the driver."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place)
    kept = scratch.keep(sorted_rows.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)))
    before, offsets = 0, []
    for part, size in sorted((r["part"], r["count"]) for r in kept.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += size
    table = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    return kept.join(F.broadcast(table), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def resample_by_segments(docs: DataFrame, target: DataFrame, keep_percent: int = KEEP_PERCENT, least_words: int = LEAST_WORDS,
                         seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs(doc_id, text)``, towards ``target(text)``.

    ``keep_percent`` of the rows with at least ``least_words`` words are drawn, rounded down: those of the highest
    score, ties to the smaller id; the others have no rank. Null, empty and wordless texts have no features and weight
    0 and are not drawn. A repeated row is a document of its own and ranks next to its copy, in either order. Rows
    without an id share one noise and come last in a tie. Other columns are not looked at; empty documents give an
    empty result, an empty target a flat one.
    """
    scratch = Scratch(docs.sparkSession, "segments")
    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    gain = gains(bucket_counts(documents_of(target, "text")), bucket_counts(texts.select("text")))
    scored = scratch.keep(texts.mapInArrow(_score(gain, seed), "doc_id long, n_features long, weight long, score long"))
    # A text of n words has n + (n - 1) + (n - 2) runs.
    least = sum(max(0, least_words - n) for n in range(RUN))
    fit = scored.filter(F.col("n_features") >= least)
    k = keep_percent * fit.count() // 100
    if k == 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    bound, _ = _kth_largest(fit.select(F.col("score").alias("key")), k)
    drawn = (F.col("score") >= bound) & (F.col("n_features") >= least)
    top = ranked(scored.filter(drawn), scratch)
    top = top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")).unionByName(top)
