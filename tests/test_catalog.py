"""Queries over whole tables: the merge fed with deliveries, references of the texts themselves."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@needs_tables
def test_merge_of_whole_deliveries_equals_its_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view corpus_snapshots as select * from '{SF}/corpus_snapshots.parquet'")
    want = db.sql(e.oracle_sql()["merge_changes"])
    got = e.queries()["merge_changes"](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and "removed" in {r.change_type for r in got}


TOKEN = re.compile(r"(?!0{1,3}[A-Za-z]?\.)([0-9]{1,3}[A-Za-z]?)\.([0-9]{1,5}[A-Za-z]{0,3})(?:\([^)]*\))*")
GAP = re.compile(r"\s*,\s*(?:(?:and|or)\s+)?|\s*&\s*|\s*[-–—]\s*|\s+(?:and|or|to|through)\s+", re.I)


def brute_sections(text):
    out = {}
    for lead in re.finditer(r"\bMCL\s+", text, re.I):
        at, items, seps = lead.end(), [], [""]
        while m := TOKEN.match(text, at):
            items.append(m)
            at = m.end()
            if not (g := GAP.match(text, at)) or not TOKEN.match(text, g.end()):
                break
            seps.append(g.group().strip().lower())
            at = g.end()
        span = [s in ("to", "through", "-", "–", "—") for s in [*seps, ""]]
        for i, m in enumerate(items):
            out.setdefault((f"MCL {m.group(1).upper()}.{m.group(2).lower()}", m.group()), span[i] or span[i + 1])
    return {(k, raw, r) for (k, raw), r in out.items()}


@needs_tables
def test_section_references_of_documents(spark, tmp_path):
    texts = {1: "See MCL 1.2, 3.4(1) to 5.6a and mcl 12a.7. MCL 0.5 is none.", 2: "Const 1963, art IV, § 5; MCL 8.1-8.9; 1931 PA 328", 3: None, 4: "MCL 8.1 and MCL 8.1"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("not coalesce(text, '') rlike '(?i)being'").collect()}
    ids = set(docs)
    for folder, have in ((str(tmp_path), texts), (SF, docs)):
        rows = [r for r in e.queries()["xref_documents_all"](spark, folder).collect() if folder != SF or r.doc_id in ids]
        assert {(r.doc_id, r.key, r.raw, r.in_range) for r in rows if r.kind == "mcl"} == {(i, *x) for i, t in have.items() for x in brute_sections(t or "")}
        if folder != SF:
            assert {(r.doc_id, r.key) for r in rows if r.kind != "mcl"} == {(2, "Const 1963, art 4, § 5"), (2, "1931 PA 328")}
