"""The landing tool with a made-up site and clock."""

import pytest

from legis_engine.sources.landing import Client, Disallowed, discover_chapters, files_for, land_html, land_xml


class Site:
    def __init__(self, pages, robots=(200, b"User-agent: *\nDisallow: /private\nCrawl-delay: 3")):
        self.pages, self.robots, self.now, self.slept, self.calls = pages, robots, 0.0, [], []

    def send(self, url, headers, timeout):
        if url.endswith("/robots.txt"):
            return self.robots[0], {}, self.robots[1]
        self.calls.append((url, headers))
        page = self.pages[url]
        page = page.pop(0) if isinstance(page, list) else page
        return page if isinstance(page, tuple) else (200, {}, page)

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def client(self, **kw):
        return Client("tests (a@example.invalid)", send=self.send, sleep=self.sleep, clock=lambda: self.now, **kw)


def test_rules_spacing_and_retries():
    s = Site({"http://x/a": b"A", "http://x/b": [(503, {}, b""), (429, {"retry-after": "7"}, b""), (200, {}, b"B")], "http://x/c": (304, {}, b""), "http://x/gone": (404, {}, b"")})
    c = s.client()
    assert c.get("http://x/a")[2] == b"A" and s.slept == []
    assert c.get("http://x/b")[2] == b"B" and s.slept[0] == 3 and 7.0 in s.slept
    assert c.get("http://x/c", etag="e")[0] == 304 and s.calls[-1][1]["If-None-Match"] == "e"
    with pytest.raises(OSError):
        c.get("http://x/gone")
    with pytest.raises(Disallowed):
        c.get("http://x/private/1")
    with pytest.raises(Disallowed):
        Site({}, (500, b"")).client().get("http://x/a")
    assert Site({"http://x/a": b"A"}, (500, b"")).client(robots_error_ok=True).get("http://x/a")[0] == 200
    assert Site({"http://x/private": b"A"}, (404, b"")).client().get("http://x/private")[0] == 200
    with pytest.raises(ValueError):
        Client("anonymous")


def listing(*rows):
    return "".join(f'{at} {size} <A HREF="/doc/Chapter%20{c}.xml">x</A><br>' for c, at, size in rows).encode()


def test_landing_xml_skips_what_is_known(tmp_path):
    pages = {"http://x/doc/": listing(("5", "1/1/2026  1:00 AM", 2), ("760", "1/1/2026  1:00 AM", 3)), "http://x/doc/Chapter%205.xml": b"<5/>", "http://x/doc/Chapter%20760.xml": b"<760/>"}
    s = Site(pages)
    assert land_xml(s.client(), "http://x/doc/", str(tmp_path))["fetched"] == ["Chapter 5.xml", "Chapter 760.xml"]
    assert land_xml(s.client(), "http://x/doc/", str(tmp_path)) == {"fetched": [], "unchanged": ["Chapter 5.xml", "Chapter 760.xml"], "vanished": []}
    pages["http://x/doc/"] = listing(("760", "1/2/2026  1:00 AM", 3))
    assert land_xml(s.client(), "http://x/doc/", str(tmp_path)) == {"fetched": ["Chapter 760.xml"], "unchanged": [], "vanished": ["Chapter 5.xml"]}
    assert land_xml(s.client(), "http://x/doc/", str(tmp_path), ["771a"])["unchanged"] == ["Chapter 760.xml"]
    files, covered = files_for(["767a", "5"])
    assert files == ["5", "760"] and {"5", "760", "771A", "777"} <= set(covered) and len(covered) == 21


def test_discovery_and_html(tmp_path):
    page = lambda c, n: f'<main><table class="docTable"><tr><td><strong>Chapter {c}</strong></td><td><a href="/Home/RenderDoc?objectName=mcl-chap{c}">H</a></td></tr></table><a href="?objectName={n}">Next Document</a></main>'.encode()
    pages = {f"http://x/Home/Document?objectName=mcl-chap{c}": page(c, n) for c, n in (("1", "mcl-chap2"), ("2", "mcl-chap3a"), ("3a", "mcl-act-1"))}
    pages |= {f"http://x/Home/RenderDoc?objectName=mcl-chap{c}": b"<html>" for c in ("1", "2", "3A")}
    s = Site(pages)
    assert discover_chapters(s.client(), "http://x") == ["1", "2", "3A"]
    assert land_html(s.client(), "http://x", str(tmp_path)) == ["1", "2", "3A"] and (tmp_path / "chapter-3A.html").exists()
    pages["http://x/Home/Document?objectName=mcl-chap2"] = page("9", "x")
    with pytest.raises(ValueError):
        discover_chapters(s.client(), "http://x")
