"""Web sources through a made-up site, the HTTP server, and the feed as a stream."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from test_landing import Site, listing
from test_sources import ACT, chapter, section

from legis_engine.api import Service
from legis_engine.operators.merge import IntegrityError
from legis_engine.refresh import EVENT_COLUMNS, Feed
from legis_engine.server import build
from legis_engine.sources import chapters as ch
from legis_engine.sources.loaders import get_source
from legis_engine.store import Store
from legis_engine.streaming.feed_stream import log_feed, source_stream


def site(*names):
    pages = {f"http://x/documents/mcl/Chapter%20{c}.xml": chapter(c, (*ACT, section(f"{c}.1"))) for c in names}
    here = listing(*[(c, "1/1/2026  1:00 AM", 5) for c in names]).replace(b"/doc/", b"/documents/mcl/")
    return Site(pages | {"http://x/documents/mcl/": here})


def test_web_sources_and_refresh_from_the_web(spark, tmp_path):
    s = site("750", "752", "37")
    crawl = get_source(spark, "mcl-xml-web", "750, 37", site="http://x", client=s.client(), landing=str(tmp_path / "land"))
    assert crawl.chapters == ["37", "750"] and {r.citation for r in crawl.documents.collect()} == {"MCL 750.1", "MCL 37.1"}
    with pytest.raises(ValueError):
        get_source(spark, "mcl-xml-web", None)
    with pytest.raises(ValueError):
        get_source(spark, "mcl-gopher", "x")
    with pytest.raises(FileNotFoundError):
        get_source(spark, "mcl-xml-web", "999", site="http://x", client=s.client(), landing=str(tmp_path / "land"))
    store = Store(spark, str(tmp_path / "db"))
    feed = Feed(store)
    events = [dict.fromkeys(EVENT_COLUMNS) | {"raw_title": "t", "citation": "MCL 752.5", "kind": "added", "feed_built_at": "2026-01-01T00:00:00Z"}]
    assert feed.take(spark.createDataFrame([tuple(e[c] for c in EVENT_COLUMNS) for e in events], ", ".join(f"{c} string" for c in EVENT_COLUMNS)))["refresh_chapters"] == ["752"]
    with pytest.raises(OSError):
        feed.refresh("mcl-xml-web", site="http://x", client=Site({"http://x/documents/mcl/": (404, {}, b"")}).client(), landing=str(tmp_path / "l2"))
    assert feed.refresh("mcl-xml-web", site="http://x", client=s.client(), landing=str(tmp_path / "l2"))["docs_new"] == 1
    assert feed.refresh("mcl-xml-web", site="http://x", client=s.client()) is None


def test_heads_of_files_tell_which_need_no_parsing(spark, tmp_path):
    files = {"a": chapter("37", (*ACT, section("37.1"))), "b": chapter("750", (*ACT, section("750.1"))), "c": chapter("760", (*ACT, section("761.1")), multi="true"), "d": b"<broken"}
    for n, data in files.items():
        (tmp_path / f"{n}.xml").write_bytes(data)
    rows = ch.parse_files(spark, str(tmp_path), "xml", ["750"]).select(F.substring_index("file", "/", -1).alias("f"), "row").distinct().collect()
    assert {r.f for r in rows} == {"b.xml", "c.xml", "d.xml"}
    (tmp_path / "d.xml").unlink()
    (tmp_path / "e.xml").write_bytes(chapter("9", ("Act 1 of 1999", "NOTHING", "An act", "")))
    with pytest.raises(IntegrityError, match="chapter 9"):
        get_source(spark, "mcl-xml-files", str(tmp_path))


def call(port, path, body=None, token=None, host=None):
    head = ({"Authorization": f"Bearer {token}"} if token else {}) | ({"Host": host} if host else {})
    req = urllib.request.Request(f"http://127.0.0.1:{port}{path}", None if body is None else json.dumps(body).encode(), head)
    try:
        with urllib.request.urlopen(req, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_server(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "data.json").write_text(json.dumps({"documents": [{"citation": "MCL 1.1", "text": "Harbors.", "chapter": "1"}], "public_acts": []}))
    store.ingest(get_source(spark, "fixture", str(tmp_path / "x")), now="2026-09-20T06:00:00Z")
    server = build(Service(store), port=0, token="secret", hosts=["127.0.0.1"])
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    try:
        assert call(port, "/healthz") == (200, {"status": "ok"})
        assert call(port, "/healthz", host="evil.example")[0] == 421
        assert call(port, "/call/search", {"query": "harbor"})[0] == call(port, "/call/search", {"query": "harbor"}, "wrong")[0] == 401
        assert [r["citation"] for r in call(port, "/call/search", {"query": "harbor"}, "secret")[1]["results"]] == ["MCL 1.1"]
        assert call(port, "/call/get_document", {"citation": "1.1"}, "secret")[1]["text"] == "Harbors."
        assert call(port, "/call/get_document", {"citation": "MCL 9.9"}, "secret")[0] == 404
        assert call(port, "/call/get_document", {"citation": "nonsense"}, "secret")[0] == call(port, "/call/get_document", {"x": 1}, "secret")[0] == 400
        assert call(port, "/call/ingest", {}, "secret")[0] == 404
    finally:
        server.shutdown()


def test_feed_log_as_a_stream(spark, tmp_path):
    """Two files of one stream: repeated events, also of other batches, are logged once."""
    put = lambda n, *rows: spark.createDataFrame([(b, t, None) for b, t in rows], "feed_built_at string, raw_title string, object_name string").coalesce(1).write.parquet(str(tmp_path / "in" / n))
    put("1", ("a", "x"), ("a", "x"), ("b", "y"))
    src = lambda: source_stream(spark, str(tmp_path / "in" / "*"))
    log_feed(src(), str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination()
    put("2", ("a", "x"), ("b", "z"), (None, "n"))
    log_feed(src(), str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted((r.feed_built_at or "", r.raw_title) for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert got == [("", "n"), ("a", "x"), ("b", "y"), ("b", "z")]
