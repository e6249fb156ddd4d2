"""Fetching source files into a folder, politely and one at a time; the engine reads folders.

Not a Spark job on purpose: the site allows about one request a second, so nothing is gained by
more workers. Transport, clock and sleep can be replaced, which is how this is tested.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256
from html import unescape
from urllib.parse import quote, unquote, urljoin, urlsplit

from .pages import parse_page

# Fixed value: the one file known to hold several chapters, and the chapters it holds.
MULTI_CHAPTER = {"760": [*(str(n) for n in range(760, 768)), "767A", *(str(n) for n in range(768, 772)), "771A", *(str(n) for n in range(772, 778))]}
MAX_CHAPTERS = 1000

Response = tuple[int, dict[str, str], bytes]


class Disallowed(RuntimeError):
    """The site's robots rules forbid the request, or cannot be read."""


def _send(url: str, headers: dict[str, str], timeout: float) -> Response:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


@dataclass
class Client:
    """At most one request per ``interval`` (or the site's crawl delay), retries with back-off,
    robots rules per origin: a missing file allows all, an unreadable one forbids unless told."""

    agent: str
    interval: float = 2.0
    retries: int = 4
    timeout: float = 180.0
    robots_error_ok: bool = False
    send: Callable[[str, dict[str, str], float], Response] = _send
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _rules: dict[str, urllib.robotparser.RobotFileParser | None] = field(default_factory=dict)
    _last: float | None = None

    def __post_init__(self):
        if not re.search(r"@|https?://", self.agent):
            raise ValueError("the user agent must say how to reach whoever crawls")

    def _allowed(self, url: str) -> float:
        """Seconds to keep between requests; raises if the rules forbid this one."""
        u = urlsplit(url)
        origin = f"{u.scheme}://{u.netloc}"
        if origin not in self._rules:
            try:
                status, _, body = self.send(f"{origin}/robots.txt", {"User-Agent": self.agent}, 15.0)
            except OSError:
                status, body = 599, b""
            parser = urllib.robotparser.RobotFileParser()
            if status == 404:
                parser.parse([])
            elif status < 300:
                parser.parse(body.decode("utf-8", "replace").splitlines())
            elif self.robots_error_ok:
                parser.parse([])
            else:
                parser = None
            self._rules[origin] = parser
        rules = self._rules[origin]
        if rules is None:
            raise Disallowed(f"the rules of {origin} cannot be read")
        if not rules.can_fetch(self.agent, url):
            raise Disallowed(url)
        return max(self.interval, float(rules.crawl_delay(self.agent) or 0))

    def get(self, url: str, etag: str | None = None, since: str | None = None) -> Response:
        gap = self._allowed(url)
        headers = {"User-Agent": self.agent} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": since} if since else {})
        for attempt in range(self.retries + 1):
            if self._last is not None and (wait := self._last + gap - self.clock()) > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                status, got, body = self.send(url, headers, self.timeout)
            except OSError as e:
                status, got, body = 599, {}, str(e).encode()
            if status < 400:
                return status, got, body
            if status not in (429, 599) and status < 500 or attempt == self.retries:
                raise OSError(f"{url}: status {status}")
            after = got.get("retry-after", "")
            self.sleep(float(after) if after.isdigit() else float(2**attempt))
        raise AssertionError


def files_for(chapters: list[str]) -> tuple[list[str], list[str]]:
    """Files that hold the wanted chapters, and all chapters those files hold."""
    files, covered = set(), set()
    for c in (c.upper() for c in chapters):
        owner = next((f for f, held in MULTI_CHAPTER.items() if c in held), c)
        files.add(owner)
        covered |= set(MULTI_CHAPTER.get(owner, [owner]))
    return sorted(files), sorted(covered)


_ENTRY = re.compile(r"(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2} [AP]M)\s+(\d+)\s+<A HREF=\"([^\"]+)\"", re.I)


def land_xml(client: Client, listing_url: str, folder: str, chapters: list[str] | None = None) -> dict[str, list[str]]:
    """Chapter XML files into ``folder``: only those new or changed since the last landing.

    Returns what was fetched, what stayed, and what the listing no longer has (kept on disk).
    """
    os.makedirs(folder, exist_ok=True)
    manifest = os.path.join(folder, "manifest.json")
    known = json.load(open(manifest)) if os.path.exists(manifest) else {}
    wanted = set(files_for(chapters)[0]) if chapters else None
    listed = {}
    for at, size, href in _ENTRY.findall(client.get(listing_url)[2].decode("utf-8", "replace")):
        name = unquote(unescape(href).rsplit("/", 1)[-1])
        m = re.fullmatch(r"Chapter (\d+[A-Z]?)\.xml", name, re.I)
        if m and (wanted is None or m.group(1).upper() in wanted):
            listed[name] = {"modified": " ".join(at.split()), "size": int(size), "url": urljoin(listing_url, href)}
    out: dict[str, list[str]] = {"fetched": [], "unchanged": [], "vanished": sorted(set(known) - set(listed)) if wanted is None else []}
    for name, e in sorted(listed.items()):
        old = known.get(name)
        if old and (old["size"], old["modified"]) == (e["size"], e["modified"]) and old.get("sha256") and os.path.exists(os.path.join(folder, name)):
            out["unchanged"].append(name)
            continue
        body = client.get(e["url"])[2]
        part = os.path.join(folder, f".{name}.part")
        with open(part, "wb") as f:
            f.write(body)
        os.replace(part, os.path.join(folder, name))
        known[name] = {"size": e["size"], "modified": e["modified"], "sha256": sha256(body).hexdigest()}
        with open(manifest + ".new", "w") as f:
            json.dump(known, f)
        os.replace(manifest + ".new", manifest)
        out["fetched"].append(name)
    return out


def discover_chapters(client: Client, base: str, start: str = "mcl-chap1") -> list[str]:
    """Chapters in the order of the download pages' next links, until one leaves the list or loops."""
    out: list[str] = []
    seen: set[str] = set()
    at: str | None = start
    while at and at not in seen and len(out) < MAX_CHAPTERS and (m := re.fullmatch(r"mcl-chap(\d+[A-Za-z]?)", at, re.I)):
        seen.add(at)
        page = parse_page(client.get(f"{base}/Home/Document?objectName={quote(at)}")[2])
        if page["object_name"] != at:
            raise ValueError(f"the page of {at} is about {page['object_name']}")
        out.append(m.group(1).upper())
        at = page["next"]
    if not out:
        raise ValueError(f"no chapter at {start}")
    return out


def land_html(client: Client, base: str, folder: str, chapters: list[str] | None = None) -> list[str]:
    """Whole-chapter HTML files into ``folder``."""
    os.makedirs(folder, exist_ok=True)
    names = [c.upper() for c in chapters] if chapters else discover_chapters(client, base)
    for c in names:
        with open(os.path.join(folder, f"chapter-{c}.html"), "wb") as f:
            f.write(client.get(f"{base}/Home/RenderDoc?objectName=mcl-chap{c}")[2])
    return names
