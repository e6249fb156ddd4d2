"""A small document tree for HTML and XML, and one way to turn it into lines of text.

Only the standard library is used. Both formats become ``Node``; the same walk renders section
bodies of either, and a completeness check compares what it gave with all the text there was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "p": {"div", "td", "th", "li", "table", "body"}, "option": {"select"}}
BLOCK = {"p", "div", "section-number", "paragraph", "section-body", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "body", "form"}
HIDDEN = {"script", "style", "template"}


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def all(self, tag: str | None = None, cls: str | None = None) -> Iterator[Node]:
        """Nodes below this one, in document order."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            if (tag is None or n.tag == tag) and (cls is None or cls in n.classes()):
                yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def first(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        return next(self.all(tag, cls), None)

    def own(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        """Direct children only."""
        return [k for k in self.kids if isinstance(k, Node) and (tag is None or k.tag == tag) and (cls is None or cls in k.classes())]

    def text(self, gap: str = "") -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in HIDDEN:
                stack.extend(reversed(k.kids))
        return gap.join(out)

    def value(self, tag: str) -> str:
        """Text of a direct child, white space as it is."""
        got = self.own(tag)
        return got[0].text() if got else ""


def squash(s: str | None) -> str:
    return " ".join((s or "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in SCOPES[tag]:
                    break
                if self.open[i].tag in CLOSES[tag]:
                    del self.open[i:]
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def html_tree(data: bytes | str) -> Node:
    if isinstance(data, bytes):
        data = data.decode("utf-8", errors="replace")
    b = _Builder()
    b.feed(data)
    b.close()
    return b.root


def _from_element(e: ElementTree.Element) -> Node:
    node = Node(str(e.tag).rsplit("}", 1)[-1], dict(e.attrib))
    if e.text:
        node.kids.append(e.text)
    for k in e:
        if isinstance(k.tag, str):
            node.kids.append(_from_element(k))
        if k.tail:
            node.kids.append(k.tail)
    return node


def xml_tree(data: bytes | str) -> Node:
    """Namespaces are dropped; bytes keep their own encoding declaration."""
    return _from_element(ElementTree.fromstring(data))


def fragment_tree(markup: str) -> Node:
    """Markup held as text in a field; read leniently if it is no XML."""
    try:
        return xml_tree(f"<fragment>{markup}</fragment>")
    except ElementTree.ParseError:
        return html_tree(markup)


def table_lines(table: Node) -> list[str]:
    return [" | ".join(squash(c.text()) for c in row.all() if c.tag.lower() in ("td", "th")) for row in table.all() if row.tag.lower() == "tr"]


def lines_of(node: Node, skip: set[int] = frozenset()) -> list[str]:
    """Lines of a body: blocks and breaks end a line, a table gives one per row, and the text
    around it keeps its place. A paragraph's number stands before its first line."""
    out: list[str] = []
    buffer: list[str] = []
    glued = False

    def flush() -> None:
        t = squash("".join(buffer))
        buffer.clear()
        if t:
            out.append(t)

    def walk(n: Node) -> None:
        nonlocal glued
        for k in n.kids:
            if isinstance(k, str):
                buffer.append(k)
                glued = glued and not k.strip()
                continue
            tag = k.tag.lower()
            if id(k) in skip or tag in HIDDEN:
                continue
            if tag == "table":
                flush()
                out.extend(x for x in table_lines(k) if x.strip(" |"))
            elif tag == "br":
                flush()
            elif tag == "paragraph-number":
                flush()
                buffer.append(k.text() + " ")
                glued = True
            elif tag in BLOCK:
                if not glued:
                    flush()
                walk(k)
                flush()
                glued = False
            else:
                walk(k)

    walk(node)
    flush()
    return out


def bare(s: str) -> str:
    """What the completeness check compares: no white space, no column marks."""
    return re.sub(r"[\s|]+", "", s)


def body_of(node: Node, skip: list[Node] = ()) -> tuple[str, bool]:
    """Text of a body and whether nothing of it was lost."""
    hidden = {id(n) for n in skip}
    lines = lines_of(node, hidden)

    def visible(n: Node) -> str:
        return "".join(k if isinstance(k, str) else visible(k) for k in n.kids if isinstance(k, str) or (id(k) not in hidden and k.tag not in HIDDEN))

    return "\n".join(lines), bare(visible(node)) == bare("".join(lines))
