"""Saved pages of the site: chapter, act, division, section and download pages, bill reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import MCL_LIVE
from ..session import ship
from .chapters import section_row
from .markup import Node, html_tree, squash

PAGE = (
    "file string, kind string, object_name string, heading string, title string, currency string, previous string, next string, download string, pdf string, "
    "act_label string, long_title string, history string, number string, catchline string, text string, notes string, banner string, act_name string, "
    "links array<struct<object_name:string,label:string,type:string,description:string>>, problem string"
)
_COLUMNS = [c.split()[0] for c in re.split(r", (?![a-z_]+:)", PAGE)]


def object_of(href: str | None) -> str | None:
    """The object a link names: a query parameter in any letter case."""
    for k, v in parse_qs(urlsplit(href or "").query).items():
        if k.lower() == "objectname" and v:
            return v[0]
    return None


def _links(main: Node) -> dict[str, str]:
    return {squash(a.text()).lower(): a.attrs.get("href", "") for a in main.all("a")}


def _table(main: Node) -> list[dict]:
    """Rows of the page's first table that lead somewhere: the cell with the link, then the next two."""
    table = main.first("table")
    out = []
    for tr in table.all("tr") if table else []:
        cells = tr.own("td")
        at = next((i for i, c in enumerate(cells) if (a := c.first("a")) and object_of(a.attrs.get("href"))), None)
        if at is None or len(cells) < at + 3:
            continue
        a = cells[at].first("a")
        out.append({"object_name": object_of(a.attrs["href"]), "label": squash(a.text()), "type": squash(cells[at + 1].text()), "description": squash(cells[at + 2].text())})
    return out


def _heading(root: Node | None, cls: str) -> tuple[str, str]:
    box = root.first("div", cls) if root else None
    return tuple(squash(n.text()) if box and (n := box.first(t)) else "" for t in ("h1", "h2"))


def parse_page(data: bytes | str) -> dict:
    """One page as a flat record; its kind is told by what it holds."""
    tree = html_tree(data)
    main = tree.first("main") or tree
    links = _links(main)
    go = lambda *names: next((o for n in names if (o := object_of(links.get(n)))), None)
    parent = next((i.attrs.get("value") for i in tree.all("input") if i.attrs.get("name") == "mclParent"), None)
    m = re.search(r"Complete\s+Through\s+PA\s+(\d+)\s+of\s+(\d{4})", squash(tree.text()), re.I)
    out = dict.fromkeys(_COLUMNS) | {"object_name": parent, "links": [], "currency": f"Michigan Compiled Laws Complete Through PA {m.group(1)} of {m.group(2)}" if m else None}
    section, division, statute, chapter = (tree.first("div", c) for c in ("sectionWrapper", "divisionWrapper", "statuteWrapper", "chapterHeading"))
    if section:
        row = section_row(section)
        return out | {
            "kind": "section", "object_name": go("download section"), "number": row["number"], "catchline": row["catchline"], "text": row["text"], "history": row["history"],
            "notes": row["notes"], "banner": row["banner"], "act_name": row["act_name"], "act_label": row["act_label"], "problem": row["message"],
            "previous": go("previous section"), "next": go("next section"), "download": links.get("download section"),
        }
    if division and tree.first("div", "divisionHeading"):
        heading, title = _heading(tree, "divisionHeading")
        return out | {"kind": "division", "heading": heading, "title": title, "links": _table(main), "previous": go("previous division"), "next": go("next division"), "download": links.get("download division")}
    if statute:
        title, label = _heading(tree, "statuteHeading")
        p = statute.own("p")
        notes = tree.first("div", "editorials")
        first = notes.first("p") if notes else None
        return out | {
            "kind": "act", "title": title, "act_label": label, "long_title": squash(p[0].text()) if p else "",
            "history": re.sub(r"^History:\s*", "", squash(first.text())) if first else "", "links": _table(main),
            "previous": go("previous statute"), "next": go("next statute"), "download": links.get("download statute"),
        }
    if chapter:
        heading, title = _heading(tree, "chapterHeading")
        return out | {"kind": "chapter", "heading": heading, "title": title, "links": _table(main), "previous": go("previous chapter"), "next": go("next chapter"), "download": links.get("download chapter")}
    render = next((a.attrs["href"] for a in main.all("a") if "/Home/RenderDoc" in a.attrs.get("href", "")), None)
    pdf = next((a.attrs["href"] for a in main.all("a") if a.attrs.get("href", "").lower().endswith(".pdf")), None)
    if render or pdf:
        cell = next((t.first("td") for t in main.all("table", "docTable") if t.first("td")), None)
        strong = cell.first("strong") if cell else None
        label = squash(strong.text()) if strong else ""
        return out | {
            "kind": "document", "object_name": object_of(render), "heading": label, "title": squash(cell.text()).removeprefix(label).strip() if cell else "", "download": render, "pdf": pdf,
            "previous": go("previous document"), "next": go("next document"),
        }
    return out | {"kind": "unknown", "problem": "no known page structure"}


BILL = "file string, stage string, object_name string, label string, year int, type string, number int, description string, date_from string, date_to string"
_BILL_COLUMNS = [c.split()[0] for c in BILL.split(", ")]


def parse_bill_report(data: bytes | str) -> list[dict]:
    """Rows of a pending-legislation report: each stage heading's next table."""
    tree = html_tree(data)
    main = tree.first("main") or tree
    dates = {i.attrs.get("name"): i.attrs.get("value") or None for i in main.all("input")}
    out, stage = [], None
    for n in main.all():
        if n.tag == "h3":
            stage = squash(n.text())
        elif n.tag == "table" and stage is not None:
            for tr in n.all("tr"):
                cells = tr.own("td")
                a = cells[0].first("a") if len(cells) >= 2 else None
                name = object_of(a.attrs.get("href")) if a else None
                m = re.match(r"^(\d{4})-([A-Z]+)-(\d+)$", name or "", re.I)
                if m:
                    out.append({"stage": stage, "object_name": name, "label": squash(a.text()), "year": int(m.group(1)), "type": m.group(2), "number": int(m.group(3)),
                                "description": squash(cells[1].text()), "date_from": dates.get("dateFrom"), "date_to": dates.get("dateTo")})
            stage = None
    return out


def _load(spark: SparkSession, path: str, schema: str, columns: list[str], parse) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([r | {"file": name} for r in parse(bytes(content))], columns=columns)

    return files.mapInPandas(run, schema)


def site_pages(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, PAGE, _COLUMNS, lambda b: [parse_page(b)])


def bill_report(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, BILL, _BILL_COLUMNS, parse_bill_report)


def index_ranges(links: DataFrame, description: str = "description") -> DataFrame:
    """First and last citation of an index row's "(762.1...762.16)" tail, by natural order."""
    from ..functions.citations import mcl_key, sort_key

    tail = F.regexp_extract(description, r"\(([^()]*)\)\s*$", 1)
    cites = F.transform(F.regexp_extract_all(tail, F.lit(f"({MCL_LIVE})"), F.lit(1)), mcl_key)
    keyed = F.transform(cites, lambda c: F.struct(sort_key(c).alias("k"), c.alias("c")))
    two = F.size(keyed) >= 2
    return links.withColumns({"first_citation": F.when(two, F.array_min(keyed)["c"]), "last_citation": F.when(two, F.array_max(keyed)["c"])})
