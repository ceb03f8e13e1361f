"""Removal of passages that occur earlier in the corpus, exactly and over all documents.

A window is a run of ``width`` consecutive words. A word goes if a window that covers it has the same words as a
window that starts earlier. All documents are reference for all others, so no automaton of the reference could
be broadcast within a bound; windows are routed to each other instead:

1. Anchors. The smallest fingerprint among the short word runs inside a window is its anchor. Equal windows have
   equal anchors, and neighbouring windows share theirs, so a text has few anchors for its words.
2. Only anchors that occur twice can belong to a repeated window. Finding them moves anchors, not windows.
3. Windows with such an anchor are compared by fingerprint; the earliest occurrence keeps its words. Maximal
   spans of covered words are removed.

Before each shuffle a task settles what it can by itself: of equal anchors or windows only the first one of a
chunk travels under their common key, so a passage that a third of all documents hold is never one large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premiumscope.llm.common import Scratch, Words, documents_of, gram_hashes, text_slices

WIDTH, ANCHOR_WORDS = 20, 6
CHUNK = 2_000_000  # anchors or windows of a task that are settled together


def _slide(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` values in a row, doubling the reach as far as it goes."""
    span = 1
    while span < size:
        step = min(span, size - span)
        values = pick(values[: len(values) - step], values[step:])
        span += step
    return values


def _anchors(runs: np.ndarray, width: int) -> np.ndarray:
    """Anchor of the window starting at each word (windows that cross texts included)."""
    return _slide(runs, width - ANCHOR_WORDS + 1, np.minimum)


def _starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows that lie within one text, and the text of each."""
    counts = np.maximum(words.counts() - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    return words.first[:-1][text] + np.arange(len(text)) - begins[text], text


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids; rows without one count as the last document."""
    return np.array([np.iinfo(np.int64).max if d is None else d for d in batch.column("doc_id").to_pylist()], dtype=np.int64)


def _settle(key: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows in the order of key, then ``order``; which of them is the first of its key."""
    rows = np.lexsort((*reversed(order), key))
    first = np.ones(len(rows), dtype=bool)
    first[1:] = key[rows][1:] != key[rows][:-1]
    return rows, first


def _seeds(width: int):
    schema = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("row", pa.int64()), ("sure", pa.bool_())])

    def settled(chunk: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        anchor, row = (np.concatenate(c) for c in zip(*chunk))
        rows, first = _settle(anchor, row)
        anchor, row = anchor[rows], row[rows]
        again = ~first
        again[:-1] |= ~first[1:]  # the first of several is repeated too
        key = np.where(first, anchor, row)
        distinct = np.ones(len(rows), dtype=bool)
        distinct[1:] = first[1:] | (row[1:] != row[:-1])
        parts = [key[distinct], anchor[distinct], row[distinct], again[distinct]]
        return pa.record_batch([pa.array(part) for part in parts], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            starts, text = _starts(words, width)
            if not len(starts):
                continue
            runs = gram_hashes(words.hashes(), ANCHOR_WORDS)
            anchors = _anchors(runs, width)
            inside = np.zeros(len(anchors), dtype=np.uint64)
            inside[starts] = anchors[starts]
            # A run of words occurs as an anchor if it is the anchor of one of the windows that hold it.
            size = width - ANCHOR_WORDS + 1
            edge = np.zeros(size - 1, dtype=np.uint64)
            place = np.flatnonzero((_slide(np.concatenate((edge, inside, edge)), size, np.maximum) == runs) & (runs > 0))
            owner = np.searchsorted(words.first, place, side="right") - 1
            chunk.append((runs[place].view(np.int64), batch.column("row").to_numpy()[owner]))
            held += len(place)
            if held >= CHUNK:
                yield settled(chunk)
                chunk, held = [], 0
        if chunk:
            yield settled(chunk)

    return run


def _windows(width: int):
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("sure", pa.bool_())])

    def settled(chunk: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        window, doc, row, start = (np.concatenate(c) for c in zip(*chunk))
        rows, first = _settle(window, doc, start)
        window, doc, row, start = window[rows], doc[rows], row[rows], start[rows]
        # Rows of one id at one place (a repeated row) are no earlier than each other.
        group = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (doc != doc[group]) | (start != start[group])
        # What is settled travels by its row alone; its document is compared with nothing any more.
        key, doc = np.where(later, row, window), np.where(later, 0, doc)
        return pa.record_batch([pa.array(part) for part in (key, doc, row, start.astype(np.int32), later)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            starts, text = _starts(words, width)
            if not len(starts):
                continue
            hashes = words.hashes()
            anchor = _anchors(gram_hashes(hashes, ANCHOR_WORDS), width)[starts].view(np.int64)
            wanted = np.zeros(len(starts), dtype=bool)
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
            for i, anchors in enumerate(batch.column("anchors")):
                own = slice(edges[i], edges[i + 1])
                wanted[own] = np.isin(anchor[own], anchors.values.to_numpy())
            window = gram_hashes(hashes, width)[starts[wanted]].view(np.int64)
            place = (starts - words.first[:-1][text])[wanted]
            chunk.append((window, _ids(batch)[text[wanted]], batch.column("row").to_numpy()[text[wanted]], place))
            held += len(window)
            if held >= CHUNK:
                yield settled(chunk)
                chunk, held = [], 0
        if chunk:
            yield settled(chunk)

    return run


def _cut(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            raw = words.raw.tobytes()
            counts, removed, digests, texts, spans = words.counts(), [], [], [], []
            for i, starts in enumerate(batch.column("starts")):
                size = int(counts[i])
                covered = np.zeros(size + 1, dtype=np.int64)
                if starts.is_valid and len(starts.values):
                    at = np.unique(starts.values.to_numpy())
                    covered += np.bincount(at, minlength=size + 1)[: size + 1]
                    covered -= np.bincount(np.minimum(at + width, size), minlength=size + 1)
                gone = np.cumsum(covered)[:size] > 0
                kept = np.flatnonzero(~gone) + words.first[i]
                text = b" ".join([raw[a:b] for a, b in zip(words.starts[kept].tolist(), words.ends[kept].tolist())])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    texts.append(text.decode())
                    spans.append(turns.tolist())
            columns = [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns += [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))]
                names += ["kept", "spans"]
            yield pa.record_batch(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``with_text`` also ``kept`` and ``spans`` (first
    and end word of each removed span in turn).

    A null text has no words. Rows without id count as one document after all others; rows that repeat an id count
    as one document, and equal windows at the same place of it are not earlier than each other, so a repeated row
    changes nothing. What is removed is settled for each row by its own text: rows of one id, or without id, that hold
    different texts lose only words of their own repeated windows. Other columns are not looked at; an empty table
    gives an empty result. Windows are compared by 64-bit fingerprints of their words, rows by 64 bits of id and text.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))

    seeds = texts.mapInArrow(_seeds(width), "key long, anchor long, row long, sure boolean")
    same = Window.partitionBy("key")
    seen = seeds.withColumn("times", F.count(F.when(~F.col("sure") | (F.col("key") == F.col("anchor")), True)).over(same))
    again = seen.filter("sure OR times > 1").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    again = scratch.keep(again)

    held = texts.join(again, "row").select("doc_id", "text", "row", "anchors")
    windows = held.mapInArrow(_windows(width), "key long, doc long, row long, start int, sure boolean")
    first = F.min(F.when(~F.col("sure"), F.struct("doc", "start"))).over(same)
    later = windows.withColumn("first", first).filter(F.col("sure") | (F.struct("doc", "start") > F.col("first")))
    later = scratch.keep(later.groupBy("row").agg(F.collect_set("start").alias("starts")))

    marked = texts.join(later, "row", "left").select("doc_id", "text", "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    result = marked.mapInArrow(_cut(width, with_text), schema + (", kept string, spans array<long>" if with_text else ""))
    scratch.drop(again)
    return result
