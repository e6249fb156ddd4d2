"""The driver contract on the smallest tables, and what must hold for the package as a whole."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
CHEAP = ["doc_as_of", "doc_other_forms", "data_status", "citation_normalize", "citation_sort", "chapter_outline", "xref_cites", "public_act_targets", "feed_classify", "manifest_plan", "search_boolean", "stream_feed_counts", "feed_titles", "feed_rss", "xml_roundtrip", "html_roundtrip", "chapter_ranges", "chapter_problems", "xref_being", "merge_scope", "merge_guard", "content_hash", "search_stemmed", "p1_found", "p2_found", "p3_found", "p3_ledger", "p4_found", "p4_counts", "p5_found"]


def test_contract():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f"p{n}_" + ("ids" if n == 6 else "found") for n in range(1, 6)} <= set(e.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["document_id", "valid_from", "valid_to", "status"]


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.sql(f"create view {f.stem} as select * from '{f}'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(e.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text(df.select(*cols).collect()) == text([tuple(r[i] for i in at) for r in want.fetchall()])


def test_nothing_outside_imports_the_text_package():
    for f in (ROOT / "legis_engine").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_plans_read_only_what_they_need(spark):
    """The outline never reads texts, a filter on a column reaches the scan."""
    if not Path(SF).exists():
        pytest.skip("needs the test tables")
    plan = e.queries()["chapter_outline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text:" not in plan and "PushedFilters: [IsNotNull(active)" in plan
    plan = e.queries()["p5_found"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "catchline" not in plan
