"""SentencePiece ids of texts and texts of ids, through a table of distinct chunks.

A blank becomes the marker U+2581, and one marker is put before a text. Where no piece of the vocabulary holds a marker
behind another character, no merge crosses from a word to the marker that follows it: a text is a row of chunks (a run of
markers with the word behind it), each of which the library segments alone as it does inside the text. Each distinct
chunk is segmented once, and the ids are joined back by position; decoding is the library's own.

The table of chunks lives in the worker and is emptied when full, so memory is bounded and no chunk moves between tasks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import documents_of, text_slices, worker_cache

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Bytes of chunks and ids a worker remembers, counted with what a dictionary adds to each: they bound memory only.
TABLE_BYTES, ENTRY_BYTES = 1 << 27, 200
# Characters of one text (a little more, up to the next chunk) that are chunked at once.
STRETCH = 1 << 20
_CHUNK = re.compile(f"{MARK}(?:{MARK}*[^{MARK}]+|{MARK}*)")
_BORDER = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """One model of the library, what holds for its markers, and the table of chunks met so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crossing = any(re.search(f"[^{MARK}]{MARK}", name) for name in names)
        self.lone = self.library.piece_to_id(MARK)
        self.chunked = not crossing and self.library.id_to_piece(self.lone) == MARK
        # What chunks rest on, asked of the model itself: a marker put in front, and none dropped.
        self.chunked = self.chunked and self.library.decode(self.encode_whole("  x  y ")) == "  x  y "
        self._clear()

    def encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)

    def segment(self, chunks: set[str]) -> dict[str, bytes]:
        """The table with the ids of these chunks in it, each named by what follows its first marker."""
        if self.held > TABLE_BYTES:
            self._clear()
        missing = [c for c in chunks if c not in self.known]
        if missing:
            coded = [array("i", ids).tobytes() for ids in self.library.encode(missing, num_threads=1)]
            self.known.update(zip(missing, coded))
            self.held += ENTRY_BYTES * len(missing) + sum(map(len, missing)) + sum(map(len, coded))
        return self.known

    def _clear(self) -> None:
        self.known, self.held = {"": array("i", [self.lone]).tobytes()}, 0


def pieces(path: str) -> Pieces:
    cache = worker_cache("sentencepieces")
    if path not in cache:
        cache[path] = Pieces(path)
    return cache[path]


def stretches(text: str) -> Iterator[list[str]]:
    """The chunks of a text in parts of bounded length; a part begins where a chunk does."""
    start = 0
    while start < len(text):
        border = _BORDER.search(text, start + STRETCH) if len(text) - start > STRETCH else None
        stop = border.start() if border else len(text)
        part = text[start:stop].replace(" ", MARK)
        part = part if start else MARK + part
        if part.endswith(MARK) or MARK + MARK in part:
            yield [c[1:] for c in _CHUNK.findall(part)]
        else:
            yield part[1:].split(MARK)
        start = stop


def text_ids(model: Pieces, texts: list[str | None]) -> Iterator[bytes]:
    """Ids of each text as 32-bit numbers; distinct chunks of all the texts are segmented once."""
    if not model.chunked:
        yield from (np.array(model.encode_whole(t) if t else [], np.int32).tobytes() for t in texts)
        return
    if sum(len(t) for t in texts if t) > 2 * STRETCH:  # one very long text: a part at a time
        for text in texts:
            yield b"".join(b"".join(map(model.segment(set(part)).__getitem__, part)) for part in stretches(text or ""))
        return
    parts = [[c for part in stretches(t) for c in part] if t else [] for t in texts]
    table = model.segment(set().union(*parts))
    for chunks in parts:
        yield b"".join(map(table.__getitem__, chunks))


def encode(docs: DataFrame, path: str | None = None, add_end: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of every row, as the library encodes the whole text, with the end id last.

    A null text counts as empty: only the end id. Repeated rows and null ids stay as they are, columns other than
    doc_id and text are not looked at, an empty table gives an empty result. A very long text is read whole but
    chunked a million characters at a time. A model whose pieces cross markers is used text by text.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        end = np.array([model.library.eos_id()] if add_end else [], np.int32).tobytes()
        for batch in text_slices(batches):
            coded = [ids + end for ids in text_ids(model, batch.column("text").to_pylist())]
            offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), np.int32))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and text of every row of ``encoded(doc_id, ids)``: the library's decoding of all the ids of a row.

    Null ids are carried along with a null text, no ids give the empty text. Rows may repeat; other columns are not
    looked at; an empty table gives an empty result.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces(path).library
        for batch in batches:
            rows = batch.column("ids")
            texts = [library.decode(ids.as_py()) if ids.is_valid else None for ids in rows]
            yield pa.record_batch([batch.column("doc_id"), rows, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return documents_of(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
