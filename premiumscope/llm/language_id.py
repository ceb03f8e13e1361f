"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a letter trigram binds (multiplies) the vectors of
its letters, each permuted (rotated) by its place; a document bundles (adds) those of all its trigrams, and a
language prototype adds the scaled vectors of its training documents. Prediction is the prototype with the
largest cosine. Prototypes are sums, so tasks send one vector per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import documents_of, text_slices, worker_cache

DIMENSIONS, SEED = 1024, 71
UNDETERMINED = "und"
PART_CHARS = 1 << 18  # characters of a text that are counted at once
PARTS, GRAM_BLOCK, CACHED_GRAMS = 512, 8192, 40_000
SCALE = 10_000  # training vectors are added as whole numbers, so sums do not depend on their order


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _is_letter(points: np.ndarray) -> np.ndarray:
    table = worker_cache("letters").setdefault("letter table", np.array([chr(c).isalpha() for c in range(0x3000)]))
    letter = table[np.minimum(points, len(table) - 1)]
    far = np.flatnonzero(points >= len(table))
    if len(far):
        kinds, at = np.unique(points[far], return_inverse=True)
        letter[far] = np.fromiter((chr(c).isalpha() for c in kinds.tolist()), dtype=bool, count=len(kinds))[at]
    return letter


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of lower-cased texts (three code points of 21 bits in one number), and for each
    trigram occurrence its text and which of the distinct ones it is. A trigram stands round each letter;
    every run of other characters, and either end of a text, counts as one character 0."""
    lowered = [t.lower() for t in texts]
    raw = "".join(f"\n{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    points = np.where(_is_letter(points), points, 0)
    kept = np.ones(len(points), dtype=bool)
    kept[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
    points, owner = points[kept], owner[kept]
    middle = np.flatnonzero(points[1:-1] != 0) + 1
    kinds = np.flatnonzero(np.bincount(points, minlength=1))
    place = np.zeros(int(kinds[-1]) + 1, dtype=np.int64) if len(kinds) else np.zeros(1, np.int64)
    place[kinds] = np.arange(len(kinds))
    small, size = place[points], len(kinds)
    coded = (small[middle - 1] * size + small[middle]) * size + small[middle + 1]
    if size**3 <= 1 << 22:
        grams = np.flatnonzero(np.bincount(coded, minlength=1)) if len(coded) else coded
        index = np.zeros(size**3 + 1, dtype=np.int64)
        index[grams] = np.arange(len(grams))
        at = index[coded]
    else:
        grams, at = np.unique(coded, return_inverse=True)
    names = (kinds[grams // size**2] << 42) | (kinds[grams // size % size] << 21) | kinds[grams % size]
    return names, owner[middle], at


class GramVectors:
    """Trigram -> vector, computed once per worker and emptied when full."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        cache = worker_cache("letters")
        self.letters: dict = cache.setdefault(("letters", dimensions), {})
        self.rows: dict = cache.setdefault(("grams", dimensions), {})

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > CACHED_GRAMS:
                self.letters.clear()
            rng = np.random.default_rng([SEED, point])
            self.letters[point] = (rng.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[point]

    def matrix(self, grams: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(grams) > CACHED_GRAMS:
            self.rows.clear()
        out = np.empty((len(grams), self.dimensions), dtype=np.float32)
        for i, gram in enumerate(grams.tolist()):
            row = self.rows.get(gram)
            if row is None:
                a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
                row = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
                self.rows[gram] = row
            out[i] = row
        return out

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One vector of length 1 per text (0 where it has no letters)."""
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        # A very long text is counted part by part; trigrams at the seams end with the part.
        parts = [(i, t[k : k + PART_CHARS]) for i, t in enumerate(texts) if t for k in range(0, len(t), PART_CHARS)]
        for low in range(0, len(parts), PARTS):
            owners = np.array([i for i, _ in parts[low : low + PARTS]])
            grams, owner, at = _grams([t for _, t in parts[low : low + PARTS]])
            if not len(grams):
                continue
            for start in range(0, len(grams), GRAM_BLOCK):
                inside = (at >= start) & (at < start + GRAM_BLOCK) if len(grams) > GRAM_BLOCK else slice(None)
                width = min(GRAM_BLOCK, len(grams) - start)
                cells = owner[inside] * width + at[inside] - start
                table = np.bincount(cells, minlength=len(owners) * width).reshape(len(owners), width)
                np.add.at(out, owners, table.astype(np.float32) @ self.matrix(grams[start : start + width]))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def train_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype per language from (text, lang). What reaches the driver is languages x dimensions numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = GramVectors(dimensions), {}
        for batch in text_slices(batches):
            found = np.rint(vectors.bundle(batch.column("text").to_pylist()) * SCALE).astype(np.int64)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + found[langs == lang].sum(axis=0)
        yield pa.record_batch([pa.array(list(sums), pa.string()),
                               pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"])

    parts = labelled.mapInArrow(run, "lang string, vector array<long>")
    summed = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in summed.collect():
        out.setdefault(row["lang"], np.zeros(dimensions))[row["place"]] = row["value"]
    return {lang: v / n for lang, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score appended (columns of those names are replaced).

    ``score`` is the cosine with the chosen prototype, cut to 0..1. A null text or one without letters is
    ``und`` with score 0, as is every text when there is no prototype; ties go to the first language by name.
    Null ids, repeated rows and an empty table need no special care: rows are independent of each other.
    """
    names = list(prototypes)
    table = np.array([prototypes[n] for n in names], dtype=np.float32).reshape(len(names), dimensions)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept_docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors(dimensions)
        for batch in text_slices(batches):
            found = vectors.bundle(batch.column("text").to_pylist())
            lettered = found.any(axis=1)
            if names:
                cosines = found @ table.T
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)
                chosen = [names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
            else:
                score, chosen = np.zeros(len(found)), [UNDETERMINED] * len(found)
            score = np.where(lettered, np.round(score, 6), 0.0)
            yield pa.record_batch([*batch.columns, pa.array(chosen, pa.string()), pa.array(score)],
                                  names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    fields = [*kept_docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept_docs.mapInArrow(run, T.StructType(fields))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, with prototypes learned from the labelled rows that are not held out."""
    out = held_out(F.col("doc_id"))
    training = documents_of(docs, "doc_id", "text", "lang").filter(~out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    prototypes = train_prototypes(training.select("text", "lang"))
    named = identify(documents_of(docs, "doc_id", "text"), prototypes)
    return named.select("doc_id", out.alias("held_out"), "lang_pred", "score")


