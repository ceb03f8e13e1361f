"""Resampling by segments, ball-tree search and the SentencePiece codec against brute force, and on edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from premiumscope.llm import ball_search, segments, sentencepieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def corpus():
    """Shared lines, copies, nulls, empty, wordless and very long texts, other scripts, a repeated row, a null id."""
    rng = random.Random(12)
    word = lambda: rng.choice(["Alpha", "beta", "w%d" % rng.randrange(60), "ñandú", "日本", "x_y", "A1"])
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(rng.randrange(1, 9)) for _ in range(6)]
    texts = []
    for i in range(60):
        own = [rng.choice(shared) if rng.random() < 0.4 else line(rng.randrange(0, 12)) for _ in range(rng.randrange(1, 9))]
        texts.append("\n".join(own))
    texts += [texts[3]] * 5 + [None, "", "   ", "\n\n", "-- !!", "one", "One\ntwo\nthree\nfour", " lead", "trail ", "a  b   c", "<s></s> <unk>",
                               "▁x▁▁y", "tab\there\r\nend", "z" * 300 + " " + "q" * 70, " ".join(line(9) for _ in range(900)), "\x00nul"]
    rows = [(i + 5, t) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, "alpha beta without id " * 6), (None, texts[4])]


@pytest.fixture(scope="module")
def table(spark, corpus):
    rows = [(d, t, "en", "s", 1, 7, "x", 1.0, 2) for d, t in corpus]
    return spark.createDataFrame(rows, DOCS + ", n int, line string, score double, rank int").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- resampling by segments -----------------------------------------------------------------------------

def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def resampled(docs, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t)[0])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        found, words = features(text)
        own = collections.Counter(map(bucket, found))
        weight = sum(n * math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(found), weight, score, words))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    return rows, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (40, 1), (100, 3)])
def test_resampling(spark, table, corpus, percent, least):
    target = ["alpha beta w1 w2", "日本 w3\nw4 Alpha", None, corpus[0][1]]
    items = spark.createDataFrame([(i, x, 1) for i, x in enumerate(target)], "item_id long, text string, times int")
    found = [tuple(r) for r in segments.resample_by_segments(table, items, percent, least).collect()]
    rows, drawn = resampled(corpus, target, percent, least)
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    assert sorted((r[:4] for r in found), key=key) == sorted((r[:4] for r in rows), key=key)
    ranked = sorted((r for r in found if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[0], r[3]) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_resampling_without_documents_or_target(spark, table, empty):
    assert segments.resample_by_segments(empty, table).count() == 0
    flat = segments.resample_by_segments(table, empty).filter("n_features = 0")
    assert {r["weight"] for r in flat.collect()} == {0}
    none = segments.resample_by_segments(table.filter("doc_id < 7"), empty, least_words=10**6)
    assert none.filter("rank IS NOT NULL").count() == 0 and none.count() == table.filter("doc_id < 7").count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b\n", "\n", " ", "C", "é", "-", "\n\n", "x" * 60, "\0"]), max_size=12).map("".join), max_size=6))
def test_lines_and_crossings_make_up_all_features(texts):
    cut = segments.Lines(texts)
    bucket, line = cut.features.inside()
    inside = [bucket[line == i].tolist() for i in range(len(cut.lines))]
    crossing, owner = cut.crossing()
    for i, text in enumerate(texts):
        found = [b for at in cut.order[cut.text == i] for b in inside[at]] + crossing[owner == i].tolist()
        assert sorted(found) == sorted(zlib.crc32(f.encode()) % 10000 for f in features(text)[0])


def test_a_shared_line_is_counted_once_per_task(spark):
    """Distinct lines are what the shuffle carries."""
    texts = spark.createDataFrame([("same line here\n" * 50,)] * 40, "text string").repartition(4)
    parts = texts.mapInArrow(segments._cut, "line string, bucket int, times long").filter("line IS NOT NULL")
    assert parts.count() == 4 and parts.agg(F.sum("times")).first()[0] == 2000
    assert segments.bucket_counts(texts).sum() == 40 * sum(150 - n for n in range(3))


# ---- ball-tree search -----------------------------------------------------------------------------------

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def searched(docs, items, top=10):
    words = [(d, collections.Counter(terms(t))) for d, t in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    n_all, l_all = len(words), sum(n for _, _, n in words)
    df = collections.Counter(w for _, c, _ in words for w in c)
    result = {}
    for i, text in items:
        scores = []
        for d, c, n in words:
            m = 100 - 75 + (75 * n * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        result[i] = [(None if none else d, -s) for s, none, d in sorted(scores)[:top]]
    return result


ITEMS = [(1, "Alpha w1 w2 w2 ñandú"), (2, None), (3, ""), (4, "--"), (5, "absent"), (6, "日本 a1 beta beta beta w7 w8 w9 x y"), (7, "z" * 300), (8, "one two"),
         (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20")]


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, table, corpus, small, monkeypatch):
    """Also with blocks of a few rows, and with items in several parts."""
    if small:
        monkeypatch.setattr(ball_search, "BLOCK_BYTES", 1)
        monkeypatch.setattr(ball_search, "LEAF", 3)
        monkeypatch.setattr(ball_search, "PART_BYTES", 40)
    asked = spark.createDataFrame([(i, t, "r") for i, t in ITEMS + ITEMS[:1]], "item_id long, text string, rank string")
    found = collections.defaultdict(list)
    for r in ball_search.lexical_search(table, asked).collect():
        found[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    expected = {i: hits for i, hits in searched(corpus, ITEMS).items() if hits}
    assert set(found) == set(expected)
    for i, hits in expected.items():
        rows = sorted(found[i])
        assert [r[0] for r in rows] == list(range(1, len(hits) + 1))
        assert [r[1:] for r in rows] == hits


def test_search_of_nothing(spark, table, empty):
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ball_search.lexical_search(empty, asked).count() == 0
    assert ball_search.lexical_search(table, asked.limit(0)).count() == 0
    assert ball_search.lexical_search(table.filter("text IS NULL"), asked).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 70), st.integers(1, 30), st.sampled_from([1, 3, 100]))
def test_bounds_hold_and_search_is_exact(seed, rows, width, group):
    rng = np.random.default_rng(seed)
    impacts = (rng.integers(0, 10**6, (rows, width)) * (rng.random((rows, width)) < 0.4)).astype(np.float32)
    impacts[rng.integers(0, rows, rows // 2)] = impacts[0]  # copies
    weights = rng.integers(1, 14_000, width)
    tree = ball_search.BallTree(impacts, np.sqrt(weights.astype(float)), leaf=4, group_terms=group)
    own = np.flatnonzero(rng.random(width) < 0.5)
    if not len(own):
        return
    exact = impacts.astype(np.int64)[:, own] @ weights[own]
    bounds = tree.bounds(own, weights[own])
    for (low, high), bound in zip(tree.spans, bounds):
        assert bound >= exact[tree.rows[low:high]].max()
    best = ball_search.Best(5)
    best.ids = list(range(rows))
    tree.search(own, weights[own], best)
    expected = sorted((-s, i) for i, s in enumerate(exact.tolist()) if s > 0)[:5]
    assert sorted((-s, d) for d, s in best.result()) == expected


def test_far_subtrees_are_not_scored():
    rng = np.random.default_rng(5)
    near = np.zeros((256, 40), np.float32)
    for block in range(16):
        near[block * 16 : block * 16 + 16, rng.integers(0, 40, 6)] = 500_000 + 1000 * block
    tree = ball_search.BallTree(near, np.ones(40), leaf=16, group_terms=1)
    best = ball_search.Best(3)
    best.ids = list(range(256))
    assert tree.search(np.array([1, 2]), np.array([5000, 4000]), best) < 256 / 2


# ---- SentencePiece --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())


@pytest.mark.parametrize("case", ["usual", "short stretches", "small table", "whole texts"])
def test_codec(spark, table, corpus, library, case, monkeypatch):
    model = sentencepieces.Pieces(sentencepieces.model_path())
    if case == "short stretches":
        monkeypatch.setattr(sentencepieces, "STRETCH", 50)
    if case == "small table":
        monkeypatch.setattr(sentencepieces, "TABLE_BYTES", 1000)
    if case == "whole texts":
        model.chunked = False
    texts = [t for _, t in corpus]
    found = [np.frombuffer(ids, np.int32).tolist() for ids in sentencepieces.text_ids(model, texts)]
    assert found == [library.encode(t or "") for t in texts]
    if case == "usual":
        rows = sentencepieces.decode(sentencepieces.encode(table)).collect()
        expected = [(d, library.encode(t or "") + [library.eos_id()]) for d, t in corpus]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=key) == sorted(expected, key=key)
        assert all(r["text"] == library.decode(r["ids"]) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "▁", "\n", "\t", "é", "　", "日", "😀", "\x00", "</s>", "<0x0A>", "x́", "   ", "."]), max_size=14).map("".join))
def test_chunks_are_segmented_as_inside_the_text(text):
    path = sentencepieces.model_path()
    model = sentencepieces.pieces(path)
    assert model.chunked
    (ids,) = sentencepieces.text_ids(model, [text])
    assert np.frombuffer(ids, np.int32).tolist() == model.library.encode(text)


def test_codec_edges(spark, empty, library):
    assert sentencepieces.encode(empty).count() == 0 and sentencepieces.decode(sentencepieces.encode(empty)).count() == 0
    rows = spark.createDataFrame([(1, None, 5), (2, [], 6), (3, [2], 7), (None, [2, 29871, 259, 35, 2], 8)], "doc_id long, ids array<int>, text int")
    found = {r["doc_id"]: r["text"] for r in sentencepieces.decode(rows).collect()}
    assert found == {1: None, 2: "", 3: "", None: library.decode([2, 29871, 259, 35, 2])}
    bare = sentencepieces.encode(spark.createDataFrame([(1, None)], "doc_id long, text string"), add_end=False).first()
    assert bare["ids"] == []
