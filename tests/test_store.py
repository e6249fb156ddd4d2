"""The guarded merge, the store around it and the read queries, over three small crawls."""

import json

import pytest
from pyspark.sql import functions as F

from legis_engine.api import NotFound, Service
from legis_engine.operators.merge import GuardError, IntegrityError, content_hash
from legis_engine.sources.loaders import get_source
from legis_engine.store import RANGES, Conflict, Store

T1, T2, T3 = "2026-09-20T06:00:00Z", "2026-09-21T06:00:00Z", "2026-09-22T06:00:00Z"


def doc(cite, text, catchline="About it.", **more):
    return {"citation": cite, "text": text, "catchline": catchline, "chapter": cite.split()[1].split(".")[0], "history_note": "1931, Act 328, Eff. Sept. 18, 1931"} | more


DAY1 = [
    doc("MCL 750.83", "A person who assaults another with intent to murder is guilty.", "Assault with intent."),
    doc("MCL 750.84", "Great harm less than murder; see MCL 750.83 and section rules."),
    doc("MCL 750.100", "", "Repealed. 1964, Act 1, Eff. Jan. 1, 1965.", status="repealed"),
    doc("MCL 750.520b", "First degree, being sections 750.83 to 750.84 of the Michigan Compiled Laws."),
    doc("MCL 750.520e", "Fourth degree, 1931 PA 328."),
    doc("MCL 257.627a", "School zones; MCL 750.999 applies."),
]
DAY2 = [
    doc("MCL 750.83", "A person who assaults another with intent to murder is guilty of a felony.", "Assault with intent."),
    *[d for d in DAY1 if d["citation"] not in ("MCL 750.83", "MCL 750.100")],
    doc("MCL 750.85", "Torture; see MCL 750.83."),
]
ACTS = [{"year": 2026, "number": 50, "title": "Amends the code.", "effective_date": "2026-09-21", "url": "u", "affected_citations": ["MCL 750.85", "MCL 750.83"]}]


def crawl(spark, folder, docs, acts=(), **head):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "data.json").write_text(json.dumps(head | {"documents": docs, "public_acts": list(acts)}))
    return get_source(spark, "fixture", str(folder))


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    t = tmp_path_factory.mktemp("store")
    store = Store(spark, str(t / "db"))
    first = store.ingest(crawl(spark, t / "d1", DAY1), now=T1)
    second = store.ingest(crawl(spark, t / "d2", DAY2, ACTS), guard=0.5, now=T2)
    return t, store, first, second


def counts(report):
    return tuple(report[f"docs_{k}"] for k in ("new", "modified", "removed", "restored"))


def test_two_days(filled):
    _, store, first, second = filled
    assert counts(first) == (6, 0, 0, 0) and first["docs_seen"] == 6
    assert counts(second) == (1, 1, 1, 0)
    assert store.table("versions").where("is_current").count() == 7
    v = {r.version_no: (r.is_current, r.first_seen, r.last_seen) for r in store.table("versions").where("citation = 'MCL 750.83'").collect()}
    assert v == {1: (False, T1, T1), 2: (True, T2, T2)}


def test_reads(filled):
    _, store, *_ = filled
    s = Service(store)
    assert s.get_document("750.83(1)(a)")["text"].endswith("felony.")
    assert s.get_document("MCL 750.83", "2026-09-20")["superseded_by_later_version_observed"]
    assert s.get_document("MCL 750.83", "2026-09-19")["text"] is None
    gone = s.get_document("mcl 750.100")
    assert gone["in_source_currently"] is False and gone["removed_from_source_at"] == T2
    with pytest.raises(NotFound):
        s.get_document("MCL 1.1")
    with pytest.raises(ValueError):
        s.get_document("nonsense")
    assert [r["citation"] for r in s.search("assault murder")["results"]] == ["MCL 750.83"]
    outline = s.get_chapter_outline("chapter 750")
    assert [x["citation"].split(".")[1] for x in outline["sections"]] == ["83", "84", "85", "520b", "520e"] and outline["total"] == 5
    assert {r["citation"] for r in s.get_cross_references("MCL 750.83", "cited_by")["references"]} == {"MCL 750.84", "MCL 750.520b", "MCL 750.85"}
    cites = s.get_cross_references("MCL 257.627a")["references"]
    assert [(r["citation"], r["in_database"]) for r in cites] == [("MCL 750.999", False)]
    changes = {(c["change_type"], c["citation"]) for c in s.list_changes("2026-09-21")["changes"]}
    assert changes == {("modified", "MCL 750.83"), ("new", "MCL 750.85"), ("removed", "MCL 750.100")}
    assert s.list_changes("2026-09-20")["count"] == 9
    assert s.lookup_public_act("2026 pa 50")["affected_citations"] == ["MCL 750.83", "MCL 750.85"]
    status = s.data_status()["sources"][0]
    assert (status["active_documents"], status["removed_documents"], status["last_run_status"]) == (6, 1, "ok")


def test_rerun_restore_guard_and_failures(spark, filled, tmp_path):
    t, _, *_ = filled
    store = Store(spark, str(tmp_path / "db"))
    store.ingest(crawl(spark, t / "d1", DAY1), now=T1)
    again = store.ingest(crawl(spark, t / "d1", DAY1), now=T2)
    assert counts(again) == (0, 0, 0, 0)
    assert store.table("versions").where(F.col("last_seen") == T2).count() == 6
    store.ingest(crawl(spark, t / "d2", DAY2), guard=0.5, now=T2)
    back = store.ingest(crawl(spark, t / "d1", DAY1), guard=0.5, now=T3)
    assert counts(back) == (0, 1, 1, 1)
    before = store.pointer()["snapshot"]
    with pytest.raises(GuardError):
        store.ingest(crawl(spark, tmp_path / "few", DAY1[:2]), now=T3)
    with pytest.raises(IntegrityError):
        store.ingest(crawl(spark, tmp_path / "bad", [*DAY1, doc("mcl 750.1", "x")]), now=T3)
    p = store.pointer()
    assert p["snapshot"] == before and [r["status"] for r in p["runs"][-2:]] == ["failed", "failed"]
    part = store.ingest(crawl(spark, tmp_path / "part", DAY1[:2], complete=False), now=T3)
    assert counts(part) == (0, 0, 0, 0)
    versions, changes = store.table("versions").count(), store.table("changes").count()
    assert store.collect_garbage() and (store.table("versions").count(), store.table("changes").count()) == (versions, changes) == (9, 12)
    one = store.table("versions").where("citation = 'MCL 750.83'").orderBy("version_no").collect()
    assert [(v.version_no, v.is_current) for v in one] == [(1, False), (2, False), (3, True)]


def test_a_scoped_run_rewrites_its_own_parts_only(spark, tmp_path):
    """References and index follow the changed documents; untouched parts keep their folders."""
    store = Store(spark, str(tmp_path / "db"))
    store.ingest(crawl(spark, tmp_path / "d1", DAY1), now=T1)
    before = store.pointer()["tables"]
    one = crawl(spark, tmp_path / "one", [doc("MCL 257.627a", "Zones near harbors; MCL 750.84 applies.")], complete=False)
    assert counts(store.ingest(one, now=T2)) == (0, 1, 0, 0)
    after = store.pointer()["tables"]
    mine = str(store.part("mcl", "MCL 257.627a")[0])
    for name in ("documents", "versions", "xrefs", "postings", "doc_stats"):
        assert {k for k in after[name] if after[name][k] != before[name].get(k)} == {mine}
    keys = {(r.citation, r.key) for r in store.table("xrefs").collect()}
    assert ("MCL 257.627a", "MCL 750.84") in keys and ("MCL 257.627a", "MCL 750.999") not in keys and ("MCL 750.84", "MCL 750.83") in keys
    s = Service(store)
    assert [r["citation"] for r in s.search("harbor")["results"]] == ["MCL 257.627a"] and s.search("school")["results"] == []
    assert [r["snippet"] for r in s.search("harbor")["results"]] == ["Zones near [harbors;] MCL 750.84 applies."]
    plan = store.table("postings").where(F.col("term").isin("harbor"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    stats = {r.citation: r.tokens for r in store.table("doc_stats").collect()}
    assert len(stats) == 6 and stats["MCL 257.627a"] == 3 + 2 + 7
    store.ingest(crawl(spark, tmp_path / "gone", [d for d in DAY1 if d["citation"] != "MCL 257.627a"], complete=True), guard=0.5, now=T3)
    assert s.search("harbor")["results"] == [] and "MCL 257.627a" in {r.citation for r in store.table("xrefs").collect()}
    assert store.collect_garbage() and s.get_document("MCL 750.84")["text"].startswith("Great harm")


def test_two_writers_cannot_both_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    add, once = store.commits.add, []

    def late(n, p):
        if not once:
            once.append(n)
            Store(spark, store.folder).ingest(crawl(spark, tmp_path / "b", DAY1[:1]), now=T1)
        return add(n, p)

    store.commits.add = late
    with pytest.raises(Conflict):
        store.ingest(crawl(spark, tmp_path / "a", DAY1), now=T1)
    assert [r["status"] for r in store.pointer()["runs"]] == ["ok"] and store.table("documents").count() == 1


def test_bad_acts_and_ranges_stop_the_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    with pytest.raises(IntegrityError, match="2026 PA 50"):
        store.ingest(crawl(spark, tmp_path / "a", DAY1, [ACTS[0] | {"affected_citations": ["MCL 1.1", "nothing"]}]), now=T1)
    good = crawl(spark, tmp_path / "b", DAY1, [ACTS[0], ACTS[0] | {"title": "Second.", "affected_citations": ["mcl 750.83(1)", "750.83"]}])
    good.ranges = spark.createDataFrame([("mcl", "mcl 1.1", "MCL 1.2", "1", None, None, "n", "repealed")], RANGES.replace(", active boolean, first_seen string", ""))
    with pytest.raises(IntegrityError, match="mcl 1.1"):
        store.ingest(good, now=T1)
    good.ranges = spark.createDataFrame([(i, "mcl", "MCL 1.1", "MCL 1.2", "1", None, None, n, "repealed") for i, n in ((1, "first"), (2, "another"), (0, "z"))], "ordinal int, " + RANGES.replace(", active boolean, first_seen string", ""))
    store.ingest(good, now=T1)
    assert [r.note for r in store.table("ranges").collect()] == ["another"]
    act = store.table("acts").first()
    assert (act.title, act.affected_citations) == ("Second.", ["MCL 750.83"])


def test_status_counts_by_the_crawl_that_made_the_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    c = crawl(spark, tmp_path / "a", [*DAY1[:2], doc("Const 1963, art 1, § 2", "Equal.", chapter="1")])
    c.documents = c.documents.withColumn("source", F.when(F.col("citation").startswith("Const"), "const").otherwise("mcl"))
    c.kinds = ["mcl", "const"]
    store.ingest(c, now=T1)
    assert [(s["source"], s["active_documents"]) for s in Service(store).data_status()["sources"]] == [("mcl", 3)]


def test_repeated_key_in_one_run_counts_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    r = store.ingest(crawl(spark, tmp_path / "x", [doc("MCL 1.1", "a"), doc("MCL 1.1", "b"), doc("MCL 1.1", "b")]), now=T1)
    assert counts(r) == (1, 1, 0, 0) and r["docs_seen"] == 3
    assert [(v.version_no, v.text, v.is_current) for v in store.table("versions").orderBy("version_no").collect()] == [(1, "a", False), (2, "b", True)]


def test_content_hash_equals_json_digest(spark):
    import hashlib

    rows = [("He said \"x\"\\y", "é  中\n z", None, " ", "active"), ("\x1c a\tb", "", "n", "k", "repealed")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    got = [r.h for r in df.select(content_hash(*[F.col(x) for x in "abcde"]).alias("h")).collect()]
    clean = lambda s: " ".join((s or "").split())
    want = [hashlib.sha256(json.dumps([*map(clean, r[:4]), r[4]], ensure_ascii=False).encode()).hexdigest() for r in rows]
    assert got == want
