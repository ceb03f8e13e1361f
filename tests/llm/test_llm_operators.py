"""Every operator against a brute-force version, and on the cases its docstring defines."""

import collections
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from premiumscope.llm import (
    boosting,
    cap_filters,
    language_id,
    licences,
    ngram_join,
    packing,
    pii,
    pretokens,
    resampling,
    substrings,
    tiling,
    token_counts,
)
from premiumscope.llm.common import Scratch
from premiumscope.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, base=400):
    return [f"w{rng.randrange(base)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Near copies, exact copies, shared passages, nulls, empty and long texts, a repeated row, a null id."""
    rng = random.Random(5)
    passage = words(rng, 40)
    texts = []
    for i in range(25):
        own = words(rng, rng.randint(5, 160))
        if i % 4 == 0:
            own[3:3] = passage
        texts.append(" ".join(own))
    base = texts[4].split()
    for i in range(8):
        changed = list(base)
        changed[rng.randrange(len(base))] = f"edit{i}"
        texts.append("  ".join(changed).upper() if i % 2 else "\n".join(changed))
    texts += [texts[4], texts[4], texts[7], "one two", "One\ttwo", "", "   ", None, " ".join(words(rng, 6000)), "loop it " * 40, "a"]
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[4]]


@pytest.fixture(scope="module")
def table(spark, corpus):
    """Documents with further columns whose names clash with those the operators use inside."""
    rows = [(d, t, "en" if (d or 0) % 2 else None, "s", 1, 7, "x", [1]) for d, t in [*corpus, (None, "text without an id here")]]
    return spark.createDataFrame(rows, DOCS + ", node int, token string, anchors array<int>").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def groups(links, nodes):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    expected = groups(links, {n for link in links for n in link})
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in found.collect()} == expected
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def shingles(text):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    own = WORD.findall((text or "").translate(lower))
    if len(own) < 5:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def test_ngram_join(table, corpus, empty):
    sets = {d: shingles(t) for d, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]]
    expected = groups(links, sets)
    rows = ngram_join.ngram_join(table).collect()
    assert len(rows) == len(corpus) + 1
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_shingles"] == 1 and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), expected[r["doc_id"]])
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_links_a_member_between_the_sizes_of_its_component(spark):
    """A is linked with B only, which lies between the sizes of C and D and shares fewer n-grams than either bound."""
    named = sorted((int(ngram_join._sets(pa.record_batch([pa.array([w])], names=["text"]), 1)[0][0]), w) for w in (f"w{i}" for i in range(13)))
    v, w, u1, u2, *o = [word for _, word in named]
    sets = {1: {v, *o}, 2: {u1, u2, *o}, 3: {u1, u2, w, *o}, 4: {u1, u2, *o[:8]}}
    links = [(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    assert (1, 2) in links and (1, 3) not in links and (1, 4) not in links
    docs = spark.createDataFrame([(d, " ".join(s)) for d, s in sets.items()], "doc_id long, text string").coalesce(1)
    assert {r["component_id"] for r in ngram_join.ngram_join(docs, n=1).collect()} == {1}


def test_shared_least_within_holds_for_every_size(spark):
    for t in (ngram_join.SIMILARITY, Fraction(4, 5), Fraction(1, 2)):
        def need(a, b):
            return max(1, math.ceil(Fraction(t.numerator * (a + b), t.numerator + t.denominator)) - math.ceil(max(a, b) * t) + 1)

        ranges = [(a, low, high) for a in range(1, 61) for low in range(math.ceil(a * t), math.floor(a / t) + 1)
                  for high in range(low, math.floor(a / t) + 1)]
        frame = spark.createDataFrame(ranges, "a int, low int, high int")
        bound = ngram_join._shared_least_within(t, F.col("a"), F.col("low"), F.col("high"))
        for a, low, high, least in frame.select("a", "low", "high", bound).collect():
            true = min(need(a, b) for b in range(low, high + 1))
            assert max(1, true - 1) <= least <= true


def test_prefix_tree_finds_the_same_as_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.choice(500, 60, replace=False)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(30, 60), replace=False), rng.integers(500, 900, 5)))).astype(np.uint64) for _ in range(60)]
    tree = ngram_join.PrefixTree(list(enumerate(sets)))
    for probe in sets:
        same = [i for i, s in enumerate(sets) if 4 * len(np.intersect1d(s, probe)) >= 3 * len(np.union1d(s, probe))]
        assert sorted(tree.linked(probe, ngram_join.SIMILARITY)) == same


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "1", "é", "'s", "'ll", "!", "<|endoftext|>", "日", "​", "\x1c", "\xa0", "ß", "½", ".", "\r\n", " the", "word"]
    coder = pretokens.coder(public_tokenizers.path("byte_bpe_50k.json"))
    cache = pretokens.PieceCache(public_tokenizers.path("byte_bpe_50k.json"), {"word": 1})
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.ids(text) == ids and cache.count(text) == len(ids)


def test_token_counts(table, corpus, empty, library):
    found = token_counts.token_counts(table, limit=100).collect()
    texts = dict(corpus) | {None: "text without an id here"}
    assert len(found) == len(corpus) + 1
    for r in found:
        n = len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty).count() == 0


def test_packing(table, corpus, empty, library):
    texts = dict(corpus) | {None: "text without an id here"}
    rows = packing.pack_documents(table).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        own = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(own), len(ids))
        pieces[r["doc_id"]] += [(r["start"], r["length"])]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = collections.Counter(d for d, _ in corpus) | collections.Counter([None])
    for doc, parts in pieces.items():
        total = len(library.encode(texts[doc] or "", add_special_tokens=False).ids) + 1
        assert sum(n for _, n in parts) == total * copies[doc]
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_packing_leaves_room_in_one_sequence_only():
    rng = random.Random(4)
    lengths = [rng.randint(1, 1023) for _ in range(700)]
    packed = packing.pack_lengths(lengths, 1024, packing.QUADRATIC)
    loads = [sum(n for _, _, n, _ in s) for s in packed]
    assert sum(loads) == sum(lengths) and max(loads) <= 1024 and len(packed) == -(-sum(lengths) // 1024)
    assert packing.pack_lengths([], 1024, packing.QUADRATIC) == []


@pytest.mark.parametrize("seed", range(6))
def test_packing_takes_the_cheapest_sequence_with_room(seed):
    """Against a search of all sequences for each document."""
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 1023), rng.randint(1, 60)]) for _ in range(300)]
    count = -(-sum(lengths) // 1024)
    used, costs, cut, expected = [0] * count, [0.0] * count, set(), {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [k for k in range(count) if used[k] + lengths[i] <= 1024]
        if not fits:
            cut.add(i)
            continue
        k = min(fits, key=lambda k: (costs[k], k))
        expected[i] = (k, used[k])
        used[k] += lengths[i]
        costs[k] += lengths[i] + packing.QUADRATIC * lengths[i] ** 2
    packed = packing.pack_lengths(lengths, 1024, packing.QUADRATIC)
    whole = {i: (k, offset) for k, s in enumerate(packed) for i, _, size, offset in s if size == lengths[i] and i not in cut}
    assert whole == expected
    assert {i for s in packed for i, _, _, _ in s} == set(range(len(lengths)))


def test_tiles_catch_reordered_passages():
    item = list(range(40))
    assert sorted(tiling.tiles([*range(20, 40), -1, *range(20)], item)) == [(0, 20, 20), (21, 0, 20)]
    assert tiling.tiles([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7]) == [(6, 0, 6)]
    assert tiling.tiles([1, 2, 3], [4, 5, 6]) == [] and tiling.tiles([], [1]) == []


def test_contaminated(spark, empty):
    rng = random.Random(8)
    item = words(rng, 40)
    other = words(rng, 30)
    swapped = [*item[20:], "and", *item[:20]]
    docs = [(1, " ".join(words(rng, 50) + item)), (2, "*** ".join(swapped)), (3, " ".join(words(rng, 50) + item[:12])), (4, None),
            (5, ""), (6, " ".join(other).upper()), (6, " ".join(other).upper()), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (9, "too short"), (10, None), (11, "")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = [tuple(r)[:3] for r in tiling.contaminated(frame, bench).collect()]
    assert sorted(found, key=str) == sorted([(1, 7, 40), (2, 7, 40), (6, 8, 30), (6, 8, 30), (None, 7, 40)], key=str)
    row = tiling.contaminated(frame.filter("doc_id = 1"), bench).first()
    start, end = row["bytes"]
    assert docs[0][1].encode()[start:end].decode() == " ".join(item)
    assert tiling.contaminated(empty, bench).count() == 0 and tiling.contaminated(frame, bench.limit(0)).count() == 0


def test_remove_repeats(table, corpus, empty):
    seen, expected = set(), {}
    for doc, text in sorted(set(corpus), key=lambda r: r[0]):
        own = WORD.findall(text or "")
        gone = [False] * len(own)
        for i in range(len(own) - 19):
            key = tuple(own[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        expected[doc] = (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    rows = substrings.remove_repeats(table, with_text=True).collect()
    assert len(rows) == len(corpus) + 1
    for r in rows:
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"]
        if r["doc_id"] is not None:
            assert tuple(r)[1:4] == expected[r["doc_id"]]
    assert substrings.remove_repeats(empty).count() == 0


def test_resample(spark, table, empty):
    target = spark.createDataFrame([(d,) for d in range(10, 20)] + [(None,)], "doc_id long")
    rows = resampling.resample(table, target, keep_share=0.5).collect()
    assert len(rows) == table.count()
    filled = [r for r in rows if r["log_weight"] != 0]
    assert 0.4 * len(filled) <= sum(r["kept"] for r in rows) <= 0.6 * len(filled) + 2
    again = resampling.resample(table.repartition(2), target, keep_share=0.5).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert resampling.resample(empty, target).count() == 0
    good = " ".join(["fine"] * 30)
    pair = spark.createDataFrame([(i, good if i < 30 else "poor " * 30) for i in range(60)], "doc_id long, text string")
    kept = [r["doc_id"] for r in resampling.resample(pair, pair.filter("doc_id < 30"), 0.5).collect() if r["kept"]]
    assert sum(d < 30 for d in kept) > 0.9 * len(kept)


def test_kth_largest(spark):
    values = [-(1 << 62), -5, -5, 0, 3, 7, 7, 1 << 40, 1 << 62]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    ranked = sorted(values, reverse=True)
    for k in range(1, len(values) + 1):
        assert resampling._kth_largest(keys, k)[0] == ranked[k - 1]


def test_language_id(spark, table, empty):
    rng = random.Random(6)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(40))
    kinds = {"aa": ["ba", "ko", "ri"], "bb": ["ßen", "üll", "ach"], "cc": ["日本", "語の", "文"]}
    rows = [(i, make(kinds[k]), k, "s", 0) for i, k in enumerate(list(kinds) * 20)]
    rows += [(900, None, "aa", "s", 0), (901, "123 !!", "bb", "s", 0), (902, "", None, "s", 0), (None, make(kinds["aa"]), None, "s", 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", lang_pred string")
    found = language_id.language_id(docs).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows[:60]}
    for r in found:
        if r["doc_id"] in truth:
            assert r["lang_pred"] == truth[r["doc_id"]] and 0 < r["score"] <= 1
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        elif r["doc_id"] is not None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.language_id(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(table.limit(5), {}).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    checked = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, total = checked.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.98 * total


def base_by_regex(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [(start, end, kind) for start, _, kind, end in sorted(found)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.", "@", "@x", ".c", "1", "22", ".", "333", "-", " ", "+", "(", ")", "%", "é", "4111111111111111", "+1 (243) 555-5526", "1.2.3.4", "0255"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == base_by_regex(text)
    assert pii.base_spans("9" * 5000 + ".1.1.1") == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_personal_data(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit_spans(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pii.find_personal_data(docs, model).collect():
        base = base_by_regex(texts[r["doc_id"]] or "")
        named = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(",")) or not named
        assert (r["n_email"], r["n_ip"]) == (sum(k == "email" for _, _, k in base), sum(k == "ip" for _, _, k in base))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "mail a@b.co now", "x"), (3, "mail a@b.co now", "x")], "doc_id long, text string, spans string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(odd, model).collect()}
    assert found == {1: "", 2: "", None: "email:5:11", 3: "email:5:11"}
    assert {r["text"] for r in pii.redact(odd, model).collect()} == {None, "", "mail [EMAIL] now"}
    assert pii.fit_spans(empty).thresholds == {} and pii.find_personal_data(empty, pii.SpanModel()).count() == 0


def test_written_out_addresses_are_found_however_many_there_are(spark):
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9)))
    forms = ["{} at {} dot com", "{} [at] {}.org", "{}(AT){} dot net"]
    rows = [(i, f"The {name()} {name()} of {name()}, {name()}@{name()}.com, {name()} {name()}") for i in range(40)]
    planted = {}
    for i in range(100, 700):
        address = forms[i % 3].format(name(), name())
        planted[i] = (f"The {name()} {name()} and {name()}: ", address, f", {name()} {name()}")
    rows += [(i, "".join(parts)) for i, parts in planted.items()]
    rows += [(i, f"They {name()} and looked at {name()}.{name()} {name()}") for i in range(1000, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, pii.fit_spans(docs)).collect()}
    right = sum(found[i] == f"email:{len(a)}:{len(a) + len(b)}" for i, (a, b, _) in planted.items())
    assert right >= 0.95 * len(planted)
    assert sum(bool(found[i]) for i in range(1000, 1200)) <= 4


def test_a_threshold_counts_all_rows_of_its_score():
    assert pii._threshold([(0.9, 1), (0.8, 1), (0.8, 0)]) == 0.9
    assert pii._threshold([(0.8, 1), (0.8, 0)]) is None and pii._threshold([]) is None


def test_spans_are_learned_from_every_candidate(spark):
    rng = random.Random(8)
    name = lambda k: "".join(rng.choice("abcdefghijklmnoprstuvw0123456789") for _ in range(k))
    rows = [(i, f"see {name(3)} at {name(rng.randint(3, 30))}.{name(rng.randint(3, 9))} or {name(rng.randint(24, 40))}7 too") for i in range(2500)]
    rows += [(i, f"the token = '{name(rng.randint(24, 40))}x1' and {name(5)}@{name(6)}.com") for i in range(3000, 3400)]
    rows += [rows[0]] * 500 + [(None, rows[3][1]), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    every = [e for _, t in rows if t for e in pii._examples(t)]
    assert min(collections.Counter((k, y) for k, _, y in every if k == "secret" and y == 0 or k == "email").values()) > 1000
    held = [int.from_bytes(hashlib.blake2b(repr(e).encode(), digest_size=7).digest(), "big") % 1000 < 300 for e in every]
    found = pii.fit_spans(docs)
    share = np.mean([y for (_, _, y), h in zip(every, held) if not h])
    assert found.model[0] == pytest.approx(np.log(share / (1 - share)))
    for kind in pii.ADDED:
        scored = [(int(boosting.score(found.model, f) * pii.STEPS) / pii.STEPS, y) for (k, f, y), h in zip(every, held) if h and k == kind]
        least = pii._threshold(scored)
        assert found.thresholds.get(kind) == (None if least is None else max(0.5, least))
    assert pii.fit_spans(docs.repartition(3)) == found


def test_boosted_trees_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 600), rng.integers(0, 12, 600) / 4, rng.integers(0, 2, 600)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 1.6) | (rng.random(600) < 0.1)).astype(int)
    n = rng.integers(1, 4, 600)

    def grow(rows, g, h, depth):
        leaf = (g[rows] @ n[rows] / (h[rows] @ n[rows] + 1),)
        whole, best = leaf[0] * (g[rows] @ n[rows]), (1e-9, None)
        if depth == 0 or n[rows].sum() < 10:
            return leaf
        for column in range(3):
            for bound in np.unique(x[:, column]):
                left, right = rows[x[rows, column] <= bound], rows[x[rows, column] > bound]
                if min(n[left].sum(), n[right].sum()) >= 5:
                    gain = sum((g[s] @ n[s]) ** 2 / (h[s] @ n[s] + 1) for s in (left, right)) - whole
                    best = max(best, (gain, (column, bound, left, right)), key=lambda b: b[0])
        if best[1] is None:
            return leaf
        column, bound, left, right = best[1]
        return (column, bound, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1))

    share = y @ n / n.sum()
    start = np.log(share / (1 - share))
    total = np.full(600, start)
    for _ in range(4):
        p = 1 / (1 + np.exp(-total))
        tree = grow(np.arange(600), 0.3 * (y - p), p * (1 - p), 3)
        total += [boosting._answer(tree, row) for row in x.tolist()]
    rows = [(int(b), a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, n)]
    frame = spark.createDataFrame(rows, "part int, row array<double>, label int, n long").repartition(5)
    model = boosting.fit_boosted(frame, rounds=4)
    assert [boosting.score(model, row) for row in x.tolist()] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)
    assert boosting.fit_boosted(frame.filter("n > 9")) == (0.0, []) and boosting.fit_boosted(frame.filter("label = 1"))[1] == []


def test_near_vectors(spark):
    rng = np.random.default_rng(7)
    rows, base = [], rng.standard_normal((60, 16))
    for i in range(60):
        rows.append((i, base[i].tolist(), i % 3))
        if i % 4 == 0:
            rows += [(100 + 3 * i + k, (base[i] + rng.standard_normal(16) * 0.05 * (k + 1)).tolist(), i % 3) for k in range(3)]
    rows += [(500, base[1].tolist(), 1), (501, (3 * base[1]).tolist(), None), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1),
             (505, [None, *[1.0] * 15], 1), (506, [], 1), (507, (1e200 * base[2]).tolist(), 2), (508, base[3][:8].tolist(), 0), (60, base[5].tolist(), 2)]
    valid = {i: (np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if i not in range(501, 507)}
    links = []
    for a, (x, p) in valid.items():
        for b, (y, q) in valid.items():
            if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a, b))
    expected, degree = groups(links, [r[0] for r in rows]), collections.Counter(n for link in links for n in link)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    found = cap_filters.near_vectors(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], expected[i], expected[i] == i)
    assert cap_filters.near_vectors(frame.limit(0)).count() == 0


def test_recall_of_the_filters():
    rng = np.random.default_rng(0)
    for count in (16, 32):
        code, missed = cap_filters.ProductCode(64, count), 0
        for _ in range(150):
            a = rng.standard_normal(64)
            a /= np.linalg.norm(a)
            b = rng.standard_normal(64)
            b -= a * (a @ b)
            b /= np.linalg.norm(b)
            near = 0.93 * a + (1 - 0.93**2) ** 0.5 * b
            missed += not set(code.filters(a).tolist()) & set(code.filters(near).tolist())
        assert missed <= 15


@pytest.mark.parametrize(("dimensions", "count"), [(64, 16), (64, 32), (64, 64), (64, 128), (16, 16), (16, 64), (4, 16)])
def test_recall_does_not_fall_with_the_code_size(dimensions, count):
    rng, missed = np.random.default_rng(11), 0
    code = cap_filters.ProductCode(dimensions, count)
    for _ in range(500):
        a, b = np.linalg.qr(rng.standard_normal((dimensions, 2)))[0].T
        near = 0.93 * a + (1 - 0.93**2) ** 0.5 * b
        missed += not set(code.filters(a).tolist()) & set(code.filters(near).tolist())
    assert missed <= 8


def test_licences(spark, empty):
    model = licences.fit_licences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    lines = {1: "Text.\nReleased under the MIT License.\nmore", 2: "Licensed under the Apache License, Version 2.0.", 3: "The driver renewed a licence to trade fish.",
             4: None, 5: "", 6: "Licensed under CC BY-NC 4.0.\r\nReleased under the MIT License.", 7: "permission was asked by the general public of the new version"}
    frame = spark.createDataFrame([(d, t, 1) for d, t in lines.items()], "doc_id long, text string, line int")
    found = {(r["doc_id"], r["family"]) for r in licences.licence_scan(frame, model).collect()}
    assert found == {(1, "MIT"), (2, "Apache-2.0"), (6, "CC-BY-NC-4.0"), (6, "MIT")}
    assert licences.licence_scan(empty, model).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, Scratch(spark, "test").keep(stage(spark, docs, folder))
        assert docs.columns == before.columns and [t for _, t in docs.dtypes] == [t for _, t in before.dtypes]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(kept["language_id"]) == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    sets = {d: shingles(t) for d, t in kept["language_id"].items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert set(kept["ngram_jaccard_join"]) == set(groups(links, sets).values())
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = {d for d, t in kept["ngram_jaccard_join"].items() if any(i in " ".join(t.lower().split()) for i in items)}
    assert set(kept["benchmark_decontamination"]) == set(kept["ngram_jaccard_join"]) - whole
    assert set(kept["pii"]) == set(kept["benchmark_decontamination"])
    assert not any(base_by_regex(t) for t in kept["pii"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept["pii"])


def test_clashing_types_do_not_matter(spark):
    frame = spark.createDataFrame([(1, "x y z", 2)], T.StructType.fromDDL("doc_id int, text string, `doc.id` int"))
    assert token_counts.token_counts(frame).first()["doc_id"] == 1


def test_near_copy_stage_decides_by_row(spark):
    text = "one two three four five six seven eight nine ten"
    near = text + " eleven"
    other = "quite another text with more than five words"
    rows = [(3, text), (2, text), (5, other), (6, None), (7, ""), (None, text), (2, other), (9, near), (5, other), (8, other), (7, ""), (None, "no id but " + other), (None, "no id but " + other)]
    docs = spark.createDataFrame([(d, t, "x", "s", len(t or "")) for d, t in rows], DOCS).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    # Of the ten words the smallest id stays, of the other text the smallest id (2, which also names a text of the first
    # group); texts without words all stay, and of the copies without id that resemble nothing else one.
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(2, text), (2, other), (6, None), (7, ""), (7, "")] + ([(None, "no id but " + other)] if not similar("no id but " + other, other) else []), key=str)
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], DOCS), "").count() == 0


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return 100 * len(a & b) >= 75 * len(a | b)


def test_contaminated_rows_go_and_those_that_share_their_id_stay(spark, tmp_path):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x " + leak), (1, "a clean text that shares an id"), (None, leak), (None, "clean and without an id"), (4, None), (5, leak), (5, leak)]
    docs = spark.createDataFrame([(d, t, "x", "s", 1) for d, t in rows], DOCS)
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["text"]) for r in kept)) == ["None", "a clean text that shares an id", "clean and without an id"]


def test_substrings_of_rows_that_share_an_id(spark):
    rng = random.Random(9)
    p, q, r = (" ".join(f"{k}{i}_{rng.randrange(10**6)}" for i in range(40)) for k in "pqr")
    rows = [(1, p), (2, p), (2, q), (None, p), (None, r), (None, r + " " + q), (3, q)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((str(x["doc_id"]), x["kept"], x["n_removed"]) for x in substrings.remove_repeats(docs, with_text=True).collect())
    assert found == sorted([("1", p, 0), ("2", "", 40), ("2", q, 0), ("3", "", 40), ("None", "", 40), ("None", r, 0), ("None", r, 40)])


ISOLATED = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
def found(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.record_batch([pa.array([importlib.util.find_spec("premiumscope") is not None] * batch.num_rows)], names=["found"])
assert not spark.range(1).mapInArrow(found, "found boolean").first()[0], "the worker can import the package"
from premiumscope.llm.catalogue import REGISTRY
from premiumscope.operators.joint import fit_joint
for name in sys.argv[3].split(","):
    print(name, REGISTRY[name][0](spark, "/root/testdata/sf0.001").count())
rows = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id + 1 AS DOUBLE) AS y", "array(id % 3) AS g")
from premiumscope.operators.joint import Block
print("joint", fit_joint(rows, ["x"], ["y"], [Block("g", 3)], max_epochs=2).score(rows, {"y": "p"}).filter("p > 0").count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Tasks of a session that has the package on the driver's path alone."""
    script = tmp_path / "run.py"
    script.write_text(ISOLATED)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = "op2_token_counts,op3_decontamination,op4_substring_dedup,op9_personal_data,op11_target_resampling,op12_lexical_search,op13_sentencepiece_codec"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), root, str(tmp_path / "shared"), names], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    lines = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "joint")))
    assert set(lines) == {*names.split(","), "joint"} and lines["joint"] == "50" and lines["op13_sentencepiece_codec"] == "200"
