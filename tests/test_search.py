"""Search against SQLite's FTS5 on random documents and queries."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from legis_engine.functions.stemming import porter
from legis_engine.operators import search as se

WORDS = "assault assaults assaulting murder felony Café cafe section penalty penalties relational hopping 750.83 84 the of O'Neil".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    rows = [(i, f"MCL 750.{i}", text(rnd.randint(0, 4)), text(rnd.randint(0, 30))) for i in range(60)]
    lite = sqlite3.connect(":memory:")
    lite.execute("create virtual table f using fts5(citation, catchline, text, tokenize='porter unicode61')")
    lite.executemany("insert into f(rowid, citation, catchline, text) values (?, ?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, citation string, catchline string, text string")
    fields = list(se.WEIGHTS)
    return lite, docs, se.postings(docs, "doc_id", fields).cache(), se.doc_stats(docs, "doc_id", fields).cache()


def fts_expression(q):
    """The same query in FTS5's own syntax: each word quoted."""
    import re

    return " ".join(p if p in ("AND", "OR", "NOT") else '"' + p.strip('"') + '"' for p in re.findall(r'"[^"]+"|\S+', q))


def queries():
    rnd = random.Random(3)
    out = ["assault", "penalty", '"section penalty"', "750.83", "cafe", "the AND murder", "assault NOT felony", "murder OR felony penalty", "a NOT b OR assault AND murder NOT the", "zzz"]
    for _ in range(14):
        parts = []
        for k in range(rnd.randint(1, 4)):
            if k:
                parts += rnd.choice([[], ["AND"], ["OR"], ["NOT"]])
            parts.append(rnd.choice(WORDS) if rnd.random() < 0.7 else f'"{rnd.choice(WORDS)} {rnd.choice(WORDS)}"')
        out.append(" ".join(parts))
    return out


def test_scores_equal_fts5(corpus):
    lite, _, index, stats = corpus
    for q in queries():
        want = {r[0]: r[1] for r in lite.execute("select rowid, bm25(f, 10.0, 5.0, 1.0) from f where f match ?", (fts_expression(q),))}
        parsed = se.parse_query(q)
        got = {r.doc_id: r.score for r in se.bm25(se.match(index, "doc_id", parsed), stats, "doc_id", parsed).collect()}
        assert got.keys() == want.keys(), q
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), q


def test_stems_equal_fts5():
    lite = sqlite3.connect(":memory:")
    lite.execute("create virtual table f using fts5(t, tokenize='porter ascii')")
    lite.execute("create virtual table v using fts5vocab(f, 'instance')")
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll penalties assaulting statutes yearly".split()
    lite.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(words, 1)))
    want = {words[r[1] - 1]: r[0] for r in lite.execute("select term, doc from v")}
    assert {w: porter(w) for w in words} == want


def test_query_language():
    for bad in ("", "   ", "AND OR", '"" ()', "x AND OR y"):
        with pytest.raises(se.QueryError):
            se.parse_query(bad)
    assert se.parse_query("AND x NOT").tree == ("and", [("p", 0)])
    assert se.parse_query('"***"').tree == ("none",) and se.parse_query('"***" y').tree == ("and", [("p", 0)])
    assert [se.normalise_chapter(c) for c in ("chapter 750", "Chap 767a", " 12 ")] == ["750", "767A", "12"]


def test_ranked_search_and_filters(spark):
    rows = [
        (1, "MCL 1.1", "Assault.", "A person who assaults another " + "x " * 60 + "is guilty", "mcl", "1", "active", True, "", "u"),
        (2, "MCL 1.2", "Other.", "assault", "mcl", "1", "repealed", True, "", "u"), (3, "MCR 2.1", "Other.", "assaulting", "mcr", None, "active", True, "", "u"),
        (4, "MCL 1.4", "Assault.", "assault", "mcl", "1", "active", False, "", "u"), (5, "MCL 1.5", "Assault.", "assault", "mcl", "1", "active", True, "new", "u"), (6, "MCL 2.1", None, None, "mcl", "2", "active", True, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, citation string, catchline string, text string, source string, chapter string, status string, active boolean, variant string, url string")
    ids = lambda **k: [r.doc_id for r in se.search(docs, "assault", **k).collect()]
    assert sorted(ids()) == [1, 3] and sorted(ids(include_repealed=True)) == [1, 2, 3] and ids(source="MCR") == [3] and ids(chapter="chapter 1") == [1] and len(ids(limit=0)) == 1
    cut = se.search(docs, "guilty").first().snippet
    assert cut.startswith("… ") and cut.endswith("[guilty]")
    assert se.search(docs.where(F.lit(False)), "assault").count() == 0
