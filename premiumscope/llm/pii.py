"""Personal data: fixed formats, and further spans chosen by boosted trees over generated candidates.

Base spans (email, ip, card, phone) are format matches with their checks. Generators then propose further,
possibly overlapping spans with high recall: written-out addresses, phone numbers without a plus sign, digit
groups, assigned secrets. Boosted trees score each from its format and its surroundings. They learn from the
text itself: base spans and the same spans in changed notation, and addresses written out in full, are examples to
find; format matches whose check failed, and candidates without any personal context, are examples to leave. The score needed is
calibrated per kind on candidates that were not learned from, so that nearly all found ones are right.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.llm.boosting import fit_boosted, score
from premiumscope.llm.common import Scratch, documents_of, text_slices

KINDS = ("email", "ip", "card", "phone")
ADDED = ("email", "phone", "number", "secret")
ORDER = {kind: i for i, kind in enumerate(("email", "ip", "card", "phone", "number", "secret"))}
# The share of the labelled candidates held back for calibration, the share that must be right, and the steps of a score.
CALIBRATION_SHARE, PRECISION, STEPS = 0.3, 0.99, 10_000
CONTEXT = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each address starts at the beginning of the run of local characters before its @, or where the match
    before it ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield start, done
        at = text.find("@", done)


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the check holds) of every format match, kind by kind."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end, True
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = (p.lstrip("0") for p in m[0].split("."))
            yield "ip", m.start(), m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
        for m in _CARD.finditer(text):
            count = m.end() - m.start() - m[0].count(" ") - m[0].count("-")
            ok = 12 <= count <= 19 and luhn(re.sub("[ -]", "", m[0]))
            yield "card", m.start(), m.end(), ok
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 9 <= len(_DIGIT.findall(m[0])) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Valid base spans (start, end, kind) by start, then kind as listed."""
    found = [(start, end, kind) for kind, start, end, ok in base_matches(text) if ok]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


# ---- candidates ---------------------------------------------------------------------------------------

_GENERATORS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
                        r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "phone": re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])"),
    "number": re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])|(?<![\w.-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![\w])"),
    "secret": re.compile(r"(?<=[=:\"'\s])[A-Za-z0-9_/+-]{24,128}(?=[\"'\s.,;#*%$&!|]|$)"),
}
_TRIGGERS = {
    "email": (" at ", "(at)", "[at]"),
}
_CUES = {
    "email": re.compile(r"mail|contact|write", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
    "number": re.compile(r"ssn|social|iban|account|passport|id\b", re.I),
    "secret": re.compile(r"token|key|secret|passw|auth|bearer|credential", re.I),
}
_WRITTEN = re.compile(r"[(\[](?:at|dot)[)\]]| dot ", re.I)
_TLD = re.compile(r"(?:com|org|net|edu|gov|io|de|fr|es|info)$", re.I)


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    digit, low = bool(_DIGIT.search(text)), text.lower()
    for kind, pattern in _GENERATORS.items():
        if kind == "email" and not any(t in low for t in _TRIGGERS["email"]):
            continue
        if kind in ("phone", "number", "secret") and not digit:
            continue
        for m in pattern.finditer(text):
            if kind != "secret" or _DIGIT.search(m[0]):
                yield kind, m.start(), m.end()


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    size = end - start
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    counts = Counter(span.lower())
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    cue = _CUES[kind].search(before)
    return [
        float(ADDED.index(kind)), float(size), digits / size, letters / size, entropy,
        float(len(re.findall(r"[0-9]+", span))), float("(" in span), float("-" in span), float(" " in span),
        float(cue is not None), float(len(before) - cue.end() if cue else CONTEXT),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'("), float(before[-1:].isalnum()),
        float(after[:1].isalnum()), float(bool(_TLD.search(span))), float(sum(c in "abcdefABCDEF" for c in span) / size),
        float(bool(re.search(r"[\[(]", span))), float(sum(c.isupper() for c in span) / size),
    ]


def _examples(text: str) -> Iterator[tuple[str, list[float], int]]:
    """Labelled candidates of one text."""
    valid = base_spans(text)
    taken = [(s, e) for s, e, _ in valid]
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    for start, end, kind in valid:
        if kind not in ("email", "phone"):
            continue
        span = text[start:end]
        if kind == "email":
            changed = span.replace("@", " at ").replace(".", " dot ")
            variants = [changed, span.replace("@", " [at] "), span.replace("@", "(at)")]
        else:
            variants = [re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)]
        for i, variant in enumerate(variants):
            cue = ("", " contact " if kind == "email" else " phone ")[i % 2]
            line = text[max(0, start - CONTEXT) : start] + cue + variant + text[end : end + CONTEXT]
            for found, s, e in candidates(line):
                if found == kind:
                    yield kind, features(kind, line, s, e), 1
    for kind, start, end in candidates(text):
        if not free(start, end):
            continue
        row = features(kind, text, start, end)
        # An address written out up to a known ending is one to find. Other written-out ones, and those after a cue,
        # may be addresses or not: nothing is learned from them.
        if kind == "email" and _WRITTEN.search(text, start, end):
            if row[15]:
                yield kind, row, 1
            continue
        if kind == "email" and row[9]:
            continue
        # A cue directly before an assigned value of mixed digits and letters marks a secret; a cue before digit
        # groups marks a number; everything else that no base format confirms is ordinary text.
        assigned = kind == "secret" and row[9] and row[11] and row[2] > 0.1 and row[3] > 0.1
        cued = kind in ("phone", "number") and row[9] and row[10] <= 4
        yield kind, row, int(bool(assigned or cued))


@dataclass
class SpanModel:
    model: tuple = (0.0, [])
    thresholds: dict[str, float] = field(default_factory=dict)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Base spans and accepted candidates that touch none of them; of overlapping ones the best scored."""
        found = base_spans(text)
        scored = []
        for kind, start, end in candidates(text) if self.thresholds else ():
            if kind in self.thresholds:
                p = score(self.model, features(kind, text, start, end))
                if p >= self.thresholds[kind]:
                    scored.append((-p, start, end, kind))
        if not scored:
            return found
        taken = sorted((s, e) for s, e, _ in found)
        for _, start, end, kind in sorted(scored):
            if all(end <= s or start >= e for s, e in taken):
                taken.append((start, end))
                found.append((start, end, kind))
        return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def _labelled(docs: DataFrame) -> DataFrame:
    """Every labelled candidate of every text: its features, its kind and label as one number, how often it occurs in a
    slice of texts, and whether it is held back for calibration (equal ones always together)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update((kind, tuple(row), label) for kind, row, label in _examples(text))
            rows = [(kind, list(row), label) for kind, row, label in counts]
            mark = [int.from_bytes(hashlib.blake2b(repr(r).encode(), digest_size=7).digest(), "big") for r in rows]
            yield pa.record_batch(
                [pa.array([2 * ADDED.index(k) + y for k, _, y in rows], pa.int32()), pa.array([f for _, f, _ in rows], pa.list_(pa.float64())),
                 pa.array([y for _, _, y in rows], pa.int32()), pa.array(list(counts.values()), pa.int64()),
                 pa.array([m % 1000 < 1000 * CALIBRATION_SHARE for m in mark], pa.bool_())],
                names=["part", "row", "label", "n", "held"])

    return documents_of(docs, "text").mapInArrow(run, "part int, row array<double>, label int, n long, held boolean")


def _scored(held: DataFrame, model: tuple) -> DataFrame:
    """How many candidates of each kind and label have a score in each step; the sizes follow the steps, not the rows."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [int(score(shared.value, row) * STEPS) for row in batch.column("row").to_pylist()]
            yield pa.record_batch([batch.column("part"), pa.array(steps, pa.int32()), batch.column("n")], names=["part", "step", "n"])

    return held.select("part", "row", "n").mapInArrow(run, "part int, step int, n long").groupBy("part", "step").agg(F.sum("n").alias("n"))


def fit_spans(docs: DataFrame) -> SpanModel:
    """Trees fitted on all labelled candidates of the whole table that are not held back, thresholds set on all those that are.

    Repeated rows count as often as they occur; null and empty texts have no candidates. Without candidates nothing but
    base spans is found.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    found = scratch.keep(_labelled(docs))
    learn = found.filter("NOT held")
    if learn.isEmpty():
        scratch.drop(found)
        return SpanModel()
    model = fit_boosted(learn)
    counts = [(r["part"], r["step"] / STEPS, r["n"]) for r in _scored(found.filter("held"), model).collect()]
    scratch.drop(found)
    thresholds = {}
    for i, kind in enumerate(ADDED):
        least = _threshold([(p, part % 2) for part, p, _ in counts if part // 2 == i], [n for part, _, n in counts if part // 2 == i])
        if least is not None:
            thresholds[kind] = max(0.5, least)
    return SpanModel(model, thresholds)


def _threshold(scored: list[tuple[float, int]], counts: list[int] | None = None) -> float | None:
    """The lowest score from which on enough are right; all rows of a score count together, each as often as it occurs."""
    least, right, n = None, 0, 0
    rows = sorted(((p, label, k) for (p, label), k in zip(scored, counts or [1] * len(scored))), reverse=True)
    for p, same in groupby(rows, key=lambda r: r[0]):
        labels = [(label, k) for _, label, k in same]
        good = sum(label * k for label, k in labels)
        right, n = right + good, n + sum(k for _, k in labels)
        if good and right / n >= PRECISION:
            least = p
    return least


# ---- operators ----------------------------------------------------------------------------------------

def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of each row.

    A null text is empty and has no spans. Null ids, repeated rows and an empty table need no special care:
    rows are independent. Columns other than doc_id and text are not looked at; positions are code points.
    """
    # Plain values: a broadcast travels to executors that need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.model, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = SpanModel(*shared.value)
        for batch in text_slices(batches):
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                counts = Counter(kind for _, _, kind in base)
                for column, kind in zip(columns, KINDS):
                    column.append(counts[kind])
                columns[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                columns[5].append(_joined(found.spans(text or "")))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                  names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """All rows and columns with every span of ``text`` replaced by its kind in brackets (overlaps as one)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.model, model.thresholds))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    place = docs.columns.index("text")

    def clean(found: SpanModel, text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for start, end, kind in found.spans(text):
            if start >= done:
                out += [text[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = SpanModel(*shared.value)
        for batch in text_slices(batches):
            columns = list(batch.columns)
            columns[place] = pa.array([clean(found, t) for t in columns[place].to_pylist()], pa.string())
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
