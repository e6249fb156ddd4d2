"""Command line: init-db, ingest, feed, status and the read queries, answers as JSON."""

from __future__ import annotations

import argparse
import json
import os
import tempfile

from .api import Service
from .refresh import Feed, summarize
from .session import build_session
from .server import build
from .sources.landing import Client
from .sources.loaders import get_source, rss_items
from .store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="legis_engine")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("init-db")
    sub.add_parser("status")
    ing = sub.add_parser("ingest")
    ing.add_argument("--source", required=True)
    ing.add_argument("--path", help="a folder; for web sources a list of chapters")
    ing.add_argument("--removal-guard", type=float, default=0.9)
    fe = sub.add_parser("feed")
    fe.add_argument("--file")
    fe.add_argument("--url")
    fe.add_argument("--record", action="store_true")
    to = fe.add_mutually_exclusive_group()
    to.add_argument("--refresh-from")
    to.add_argument("--refresh-web", action="store_true")
    fe.add_argument("--removal-guard", type=float, default=0.9)
    se = sub.add_parser("serve")
    se.add_argument("--host", default="127.0.0.1")
    se.add_argument("--port", type=int, default=8000)
    for x in (ing, fe):
        x.add_argument("--site", default=os.environ.get("LEGIS_SITE", ""), help="address of the site that web sources read")
        x.add_argument("--agent", default=os.environ.get("LEGIS_AGENT", ""), help="who crawls, and how to reach them")
    for verb, arg in (("document", "citation"), ("search", "query"), ("outline", "chapter"), ("references", "citation"), ("changes", "since"), ("act", "act")):
        sub.add_parser(verb).add_argument(arg)
    a = p.parse_args(argv)
    store = Store(build_session(), a.store)
    s = Service(store)
    if a.verb == "init-db":
        store.create()
        out = {"store": a.store}
    elif a.verb == "ingest":
        options = {"site": a.site, "client": Client(a.agent)} if a.source.endswith("-web") else {}
        out = store.ingest(get_source(store.spark, a.source, a.path, **options), a.removal_guard)
    elif a.verb == "serve":
        names = [h.strip() for h in os.environ.get("LEGIS_HOSTS", "").split(",") if h.strip()]
        build(s, a.host, a.port, os.environ.get("LEGIS_TOKEN") or None, names).serve_forever()
        return 0
    elif a.verb == "feed":
        if bool(a.file) == bool(a.url):
            p.error("feed reads a file or an address")
        client = Client(a.agent) if a.url or a.refresh_web else None
        at = a.file
        if a.url:
            at = os.path.join(tempfile.mkdtemp(prefix="legis_feed_"), "feed.xml")
            with open(at, "wb") as f:
                f.write(client.get(a.url)[2])
        events = rss_items(store.spark, at)
        feed = Feed(store)
        out = summarize(events)
        if a.record or a.refresh_from or a.refresh_web:
            out["recorded"] = feed.take(events)
        if a.refresh_from:
            out["refresh_ingest"] = feed.refresh("mcl-xml-files", a.refresh_from, a.removal_guard)
        elif a.refresh_web:
            out["refresh_ingest"] = feed.refresh("mcl-xml-web", guard=a.removal_guard, site=a.site, client=client)
    else:
        out = {
            "status": s.data_status, "document": lambda: s.get_document(a.citation), "search": lambda: s.search(a.query), "outline": lambda: s.get_chapter_outline(a.chapter),
            "references": lambda: s.get_cross_references(a.citation), "changes": lambda: s.list_changes(a.since), "act": lambda: s.lookup_public_act(a.act),
        }[a.verb]()
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
