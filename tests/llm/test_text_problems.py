"""Encoding, leakage and shared spans against plain versions of themselves."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from legis_engine.llm import encoding, leakage, spans

# --- problem 6 ------------------------------------------------------------------------------------

ENC, LEN = encoding.load_encoder(encoding.vocabulary_path())
ODD = list(" \n\t\r 'sdlmtrevaAB12é中 \u0085\x1c_.,-ß́🙂\x00") + ["'ll", "'s", "  ", "\n\n", "<|endoftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=60), st.sampled_from([1, 2, 3, 5, 8, 64]))
def test_tree_equals_plain_encoding(parts, leaf):
    s = "".join(parts)
    ids = encoding.encode_tree(s, ENC, LEN, leaf)
    assert ids == ENC(s)
    assert encoding.decode_ids(ids) == s


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.sampled_from([1, 7, 32]))
def test_tree_on_any_text(s, leaf):
    assert encoding.encode_tree(s, ENC, LEN, leaf) == ENC(s)


@pytest.mark.parametrize("s", [" " * 100_000, "a" * 100_000, "中" * 60_000, "-" * 50_000, "word " * 60_000])
def test_long_texts(s):
    assert encoding.encode_tree(s, ENC, LEN) == ENC(s)


def test_corpus(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "Hello world", "x"), (1, "Hello world", "x"), (4, "<|endoftext|>", "x"), (5, "long words " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encoding.encode_corpus(df, "doc_id", "text", leaf=100).collect()]
    assert sorted(got, key=str) == sorted([(d, ENC(t) if t else []) for d, t, _ in rows], key=str)
    assert 50256 not in got[5][1]
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# --- problem 7 ------------------------------------------------------------------------------------


def brute_leaks(docs, items, run=12):
    fold = lambda t: [w.casefold() for w in leakage._WORD.findall(unicodedata.normalize("NFC", t or ""))]
    out = set()
    for i, t in items:
        w = fold(t)
        m = min(run, len(w))
        grams = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
        for d, x in docs:
            v = fold(x)
            if any(tuple(v[k : k + m]) in grams for k in range(len(v) - m + 1)) and grams:
                out.add((d, i))
    return out


def leak_case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "é", "Straße", "STRASSE", "naïve"]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, make(rnd.choice([1, 2, 5, 11, 12, 13, 40]))) for i in range(40)] + [(100, ""), (101, None), (102, "?!"), (103, "w1"), (103, "w1")]
    docs = []
    for d in range(60):
        parts = [make(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            w = (items[rnd.randrange(40)][1] or "").split()
            a = rnd.randint(0, max(len(w) - 12, 0))
            parts += [" ,".join(w[a : a + rnd.choice([11, 12, 14])]).upper() if rnd.random() < 0.5 else " ".join(w[a : a + 12]), make(rnd.randint(0, 70))]
        docs.append((d, "-".join(parts)))
    return docs + [(900, None), (901, ""), (902, "w1")], items


@pytest.mark.parametrize("seed", range(4))
def test_leaks_equal_brute_force(seed):
    docs, items = leak_case(seed)
    index = leakage.ItemIndex(items)
    for passage in (24, 64):
        assert set(leakage.search_batch(index, docs, passage)) == brute_leaks(docs, items)


def test_leaks_on_tables_and_in_shards(spark, monkeypatch):
    docs, items = leak_case(9)
    d = spark.createDataFrame([(*r, "x") for r in docs + docs[:3]], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    want = brute_leaks(docs, items)
    assert {tuple(r) for r in leakage.leaked_items(d, i).collect()} == want
    monkeypatch.setattr(leakage, "MAX_ITEMS", 7)
    rows = [tuple(r) for r in leakage.leaked_items(d, i).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert leakage.leaked_items(d, i.limit(0)).count() == leakage.leaked_items(d.limit(0), i).count() == 0


# --- problem 8 ------------------------------------------------------------------------------------


def brute_spans(docs, span):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    covered = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                covered.setdefault(d, set()).update(range(i, i + span))
    out = set()
    for d, at in covered.items():
        s = sorted(at)
        cut = [0, *[k + 1 for k in range(len(s) - 1) if s[k + 1] != s[k] + 1], len(s)]
        out |= {(d, s[a], s[b - 1] + 1) for a, b in zip(cut, cut[1:], strict=False)}
    return out


def span_case(seed, n=40):
    rnd = random.Random(seed)
    letters = "ab é中🙂" if seed % 2 else "abcdefgh "
    make = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    pool = [make(rnd.randint(30, 200)) for _ in range(6)] + ["a" * 150, "xy" * 90]
    docs = []
    for d in range(n):
        t = make(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            a = rnd.randint(0, len(p) // 2)
            t += p[a : a + rnd.randint(10, 150)] + make(rnd.randint(0, 60))
        docs.append((d, t))
    return docs + [(500, pool[0]), (501, pool[0]), (502, None), (503, ""), (504, "short")]


@pytest.mark.parametrize(("seed", "group"), [(1, 5000), (2, 5000), (3, 2), (4, 5)])
def test_spans_equal_brute_force(spark, seed, group):
    docs = span_case(seed)
    df = spark.createDataFrame([(*r, "x") for r in docs + docs[:2]], "doc_id bigint, text string, v string")
    got = {tuple(r) for r in spans.shared_spans(df, span=60, seed=20, group=group).collect()}
    assert got == brute_spans(docs, 60)


@pytest.mark.parametrize(("seed", "group", "band"), [(1, 3, 10), (2, 1, 7), (3, 2, 10), (4, 8, 50), (5, 4, 1)])
def test_spans_of_popular_prefixes_equal_brute_force(spark, monkeypatch, seed, group, band):
    """One wording in most records, with copies, near copies and other text round it: split down to trees and windows."""
    monkeypatch.setattr(spans, "BAND", band)
    rnd = random.Random(seed)
    make = lambda k: "".join(rnd.choice("abé🙂 ") for _ in range(k))
    hot = make(55)
    docs = span_case(seed, 12) + [(600 + i, make(rnd.randint(0, 9)) + hot[rnd.randint(0, 3) :] + hot[:3] * (i % 3) + make(rnd.randint(0, 9))) for i in range(30)]
    docs += [(700 + i, "z" + docs[-1][1] + "q") for i in range(8)] + [(720, (hot + "#") * 4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_spans(df, span=60, seed=20, group=group).collect()} == brute_spans(docs, 60)


def test_spans_production_length_and_empty(spark):
    rnd = random.Random(3)
    make = lambda k: "".join(rnd.choice("abcdefghij ") for _ in range(k))
    p = make(400)
    docs = [(1, make(50) + p + make(70)), (2, p), (3, make(10) + p[:399] + "#"), (4, p[1:] + "!" + make(500)), (None, p)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == {(1, 50, 450), (2, 0, 400)}
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_anchors_of_equal_windows_agree_and_every_window_has_one():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(97, 101, 3000).astype(np.uint32)
    at, h = spans.find_anchors(codes, np.array([0]), 60, 20)
    have = np.zeros(3001, dtype=int)
    have[at] = 1
    c = np.concatenate([[0], np.cumsum(have)])
    assert all(c[i + 41] > c[i] for i in range(3000 - 60 + 1))
    one, _ = spans.find_anchors(np.concatenate([codes[:7], codes[100:400]]), np.array([0, 7]), 60, 20)
    assert set(at[(at >= 141) & (at < 340)] - 100 + 7) == {x for x in one if 48 <= x < 247}


def test_pieces_of_a_very_long_text_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spans, "_PIECE", 500)
    docs = [(1, span_case(2)[3][1] * 20), (2, "q" * 70 + span_case(2)[3][1] * 3)]
    seen = []
    for held in spans._pieces([(d, 0, t) for d, t in docs], 60):
        seen += [(d, o + i) for d, _, o, t in held for i in range(len(t) - 59)]
    assert sorted(set(seen)) == [(d, i) for d, t in docs for i in range(len(t) - 59)]
