"""Chapter files, site pages, feeds, listings and bill reports, from small made-up inputs."""

import pytest
from pyspark.sql import functions as F

from legis_engine.operators import feed as fd
from legis_engine.operators.manifest import chapter_files, plan_fetch
from legis_engine.operators.merge import IntegrityError
from legis_engine.refresh import Feed, summarize
from legis_engine.sources import chapters as ch
from legis_engine.sources.loaders import directory_listing, get_source, rss_items
from legis_engine.sources.markup import body_of, fragment_tree, html_tree, xml_tree
from legis_engine.sources.pages import bill_report, index_ranges, parse_page, site_pages
from legis_engine.store import Store


def esc(s):
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def section(number, catch="About it.", body="<Section-Body><Section-Number>Sec. 1.</Section-Number><Paragraph><P>Text.</P></Paragraph></Section-Body>", repealed="false", ref=None, notes="", comm="",
            history="<HistoryData>1931, Act 328, Eff. Sept. 18, 1931</HistoryData>"):
    return (
        f"<MCLSectionInfo><MCLNumber>{number}</MCLNumber><SectRef>{ref or number}</SectRef><CatchLine>{esc(catch)}</CatchLine><Repealed>{repealed}</Repealed>"
        f"<HistoryText>{esc(history)}</HistoryText><EditorsNotes>{notes}</EditorsNotes><Commentary>{comm}</Commentary><BodyText>{esc(body)}</BodyText></MCLSectionInfo>"
    )


def chapter(name, *statutes, multi="false", ns=""):
    parts = []
    for label, heading, long_title, inner in statutes:
        parts.append(f"<MCLStatuteInfo{ns}><Name>{label}</Name><Heading>{heading}</Heading><LongTitle>{esc(long_title)}</LongTitle><HistoryText/><MCLDocumentInfoCollection>{inner}</MCLDocumentInfoCollection></MCLStatuteInfo>")
    xml = f'<?xml version="1.0" encoding="utf-16"?><MCLChapterInfo><Name>{name}</Name><Title>TITLE</Title><MultiChapter>{multi}</MultiChapter><MCLDocumentInfoCollection>{"".join(parts)}</MCLDocumentInfoCollection></MCLChapterInfo>'
    return xml.encode("utf-16")


def division(kind, number, *inner):
    return f"<MCLDivisionInfo><DivisionType>{kind}</DivisionType><DivisionNumber>{number}</DivisionNumber><MCLDocumentInfoCollection>{''.join(inner)}</MCLDocumentInfoCollection></MCLDivisionInfo>"


def records(spark, tmp_path, *files):
    for i, data in enumerate(files):
        (tmp_path / f"c{i}.xml").write_bytes(data)
    rows = ch.parse_files(spark, str(tmp_path), "xml")
    recs = ch.records(rows, "https://x/")
    return rows, recs, {r.citation or r.number: r for r in recs.collect()}, [r.problem for r in ch.problems(rows, recs).collect()]


ACT = ("Act 328 of 1931", "THE CODE", "An act to codify")


def test_ordinary_and_nested_sections(spark, tmp_path):
    notes = "<EditorsNoteInfo><Type>Compiler</Type><Text>Former MCL 750.7 was repealed.</Text></EditorsNoteInfo><EditorsNoteInfo><Type>Other</Type><Text>x</Text></EditorsNoteInfo>"
    data = chapter("750", (*ACT, section("750.1", notes=notes) + division("Chapter", "I", division("Part", "2", section("750.2a")))), ns=' xmlns="http://y"')
    rows, recs, by, bad = records(spark, tmp_path, data)
    assert bad == []
    r = by["MCL 750.1"]
    assert (r.text, r.act_citation, r.act_name, r.status, r.chapter, r.url) == ("Sec. 1.\nText.", "1931 PA 328", "THE CODE", "active", "750", "https://x/mcl-750-1")
    assert r.history_note == "1931, Act 328, Eff. Sept. 18, 1931" and r.compilers_notes == "Compiler's Notes: Former MCL 750.7 was repealed.\nOther: x"
    assert by["MCL 750.2a"].path == "Chapter I/Part 2"
    assert [(x.start_citation, x.status) for x in ch.ranges(rows, recs).collect()] == [("MCL 750.7", "repealed")]


def test_status_words_variants_and_const(spark, tmp_path):
    gone = {"repealed": "true"}
    data = chapter(
        "750",
        (*ACT, section("750.1", "Repealed ordinances; re-enactment.") + section("750.2", "Reepaled. 2006, Act 673, Eff. Jan. 1, 2011.", **gone) + section("750.3", "750.3 Repealed. 2008, Act 181, Imd. Eff. July 9, 2008.", **gone)
         + section("750.4", "Repealed 2026, Act 25, Imd. Eff. July 21, 2026.", **gone) + section("750.5", "Rescinded.", **gone) + section("750.6.new", comm="<CommentaryInfo><Text>EFFECTIVE JANUARY 22, 2028</Text></CommentaryInfo>")
         + section("750.7[a]") + section("750.8", ref="750.8, 750.9", catch="Repealed. 1964, Act 1, Eff. Jan. 1, 1965.", **gone)),
        ("Act 5 of 1950", "OLD", "131.1-139.3 Repealed. 1943, Act 202.", ""),
    )
    const = chapter("1", ("CONSTITUTION OF MICHIGAN OF 1963", "C", "", section("Article IV § 3") + section("Schedule SigBlock", ref="§ 0") + section("Article I § 4", repealed="true", body="", history="<HistoryData>Abrogated</HistoryData>")))
    rows, recs, by, bad = records(spark, tmp_path, data, const)
    assert bad == []
    state = {k: (r.status, r.effective_date) for k, r in by.items()}
    assert state["MCL 750.1"] == ("active", None) and state["MCL 750.2"] == ("repealed", "2011-01-01") and state["MCL 750.3"] == ("repealed", "2008-07-09")
    assert state["MCL 750.4"] == ("repealed", "2026-07-21") and state["MCL 750.5"] == ("rescinded", None)
    assert (by["MCL 750.6"].variant, by["MCL 750.6"].effective_date, by["MCL 750.6"].compilers_notes) == ("new", "2028-01-22", "Site notice: EFFECTIVE JANUARY 22, 2028")
    assert (by["MCL 750.7"].variant, by["MCL 750.7"].url) == ("[a]", "https://x/mcl-750-7[a]")
    assert by["Const 1963, art 4, § 3"].source == "const" and by["Const 1963, Schedule, § 0"].chapter == "1" and state["Const 1963, art 1, § 4"][0] == "abrogated"
    got = {(r.start_citation, r.end_citation, r.status) for r in ch.ranges(rows, recs).collect()}
    assert got == {("MCL 131.1", "MCL 139.3", "repealed"), ("MCL 750.9", "MCL 750.9", "repealed")}


def test_problems_stop_the_crawl(spark, tmp_path):
    bad = chapter("750", (*ACT, section("750.1") + section("750.1") + section("BAD") + section("751.1") + section("750.2", repealed="true")))
    _, _, _, found = records(spark, tmp_path, bad, b"<Foo/>")
    assert len(found) == 5 and any("duplicate" in p for p in found) and any("root element" in p for p in found) and any("stands in chapter" in p for p in found)
    with pytest.raises(IntegrityError):
        get_source(spark, "mcl-xml-files", str(tmp_path))
    with pytest.raises(ValueError):
        get_source(spark, "nowhere", "x")


def test_bodies_keep_tables_and_loose_text():
    one = "<Section-Body><Paragraph><Paragraph-Number>(<Emph>i</Emph>)</Paragraph-Number><P>First</P><P>Second</P></Paragraph><Paragraph><P>Before<table><tr><td>a</td><td>b</td></tr></table>(2) After</P></Paragraph></Section-Body>"
    assert body_of(fragment_tree(one)) == ("(i) First\nSecond\nBefore\na | b\n(2) After", True)
    assert body_of(fragment_tree("Act 368")) == ("Act 368", True)
    assert body_of(fragment_tree("broken <P>x & y")) == ("broken\nx & y", True)
    assert xml_tree("<a xmlns='u'><b>x</b></a>").value("b") == "x"
    assert [p.text() for p in html_tree("<p>a<p>b<table><tr><td>c<td>d</table>").all("p")] == ["a", "bcd"]


WRAP = """<div class="sectionWrapper"><div class="excerpt"><h1 class="h2">THE CODE (EXCERPT)</h1><br><h1 class="h3">Act 328 of 1931</h1></div><br>
<h1 class="h4">{n} {catch}</h1><p>Sec. 1.</p><p>(1) One.<table><tr><td>a</td><th>b</th></tr></table>(2) Loose.</p>
<div class="editorials"><p><b>History:</b> 1931, Act 328, Eff. Sept. 18, 1931</p><p><b>Popular Name:</b> Act 328</p></div></div>"""


def test_html_chapter(spark, tmp_path):
    html = f"""<html><body><div class="chapterWrapper"><div class="chapterHeading"><h1>Chapter 750</h1><h2>CODE</h2></div>
    <div class="statuteWrapper"><div class="statuteHeading"><h1>THE CODE</h1><h2>Act 328 of 1931</h2></div><p>750.90-750.95 Repealed. 1940, Act 1.</p>
    <div class="divisionWrapper"><div class="divisionHeading">Chapter I</div>{WRAP.format(n="750.1", catch="Short title.")}</div>{WRAP.format(n="750.2", catch="Repealed. 1950, Act 2, Eff. Jan. 1, 1951.")}</div></div>
    <footer>Rendered 9/1/2026. Michigan Compiled Laws Complete Through PA 91 of 2026</footer></body></html>"""
    (tmp_path / "c.html").write_text(html)
    crawl = get_source(spark, "mcl-files", str(tmp_path))
    by = {r.citation: r for r in crawl.documents.collect()}
    assert by["MCL 750.1"].text == "Sec. 1.\n(1) One.\na | b\n(2) Loose." and by["MCL 750.1"].history_note.startswith("1931") and by["MCL 750.1"].compilers_notes == "Popular Name: Act 328"
    assert (by["MCL 750.2"].status, by["MCL 750.2"].effective_date) == ("repealed", "1951-01-01")
    assert crawl.chapters == ["750"] and [r.end_citation for r in crawl.ranges.collect()] == ["MCL 750.95"]


def test_warnings_do_not_stop_a_crawl(spark, tmp_path):
    html = f"""<div class="chapterWrapper"><div class="chapterHeading"><h1>Chapter 750</h1></div><div class="statuteWrapper"><div class="statuteHeading"><h1>THE CODE</h1><h2>Some 1 label</h2></div>
    <div>The People of the State of Michigan enact:</div><aside>Loose words</aside>{WRAP.format(n="750.1", catch="Short title.").replace("</div></div>", '</div><div class="commentary">EFFECTIVE MAY 1, 2026</div></div>')}</div></div>"""
    (tmp_path / "c.html").write_text(html)
    rows = ch.parse_files(spark, str(tmp_path), "html")
    recs = ch.records(rows)
    assert ch.problems(rows, recs).count() == 0
    assert {r.warning for r in ch.warnings(rows, recs).collect()} == {
        "<aside> kept out of the data: Loose words", "act label not recognised: Some 1 label", "chapter 750 has no currency stamp", "banner on an ordinary form: 750.1"}


def test_site_pages(spark, tmp_path):
    row = '<tr><td><a href="/Laws/MCL?objectName=mcl-175-1927-I">Chapter I</a></td><td>Division</td><td>DEFINITIONS (761.1...762.16)</td></tr>'
    act = f"""<main><input name="mclParent" value="mcl-Act-175-of-1927"><div class="statuteWrapper"><div class="statuteHeading"><h1>THE CODE</h1><h2>Act 175 of 1927</h2></div><p>AN ACT</p>
    <div class="editorials"><p>History: 1927, Act 175, Eff. Sept. 5, 1927</p></div></div><table><tbody>{row}</tbody></table><a href="?objectname=mcl-act-1">Next Statute</a></main>"""
    sec = f'<main>{WRAP.format(n="750.145p", catch="Caregiver.")}<a href="?objectName=mcl-750-145p">Download Section</a><a href="?objectName=mcl-750-145q">Next Section</a></main>'
    doc = '<main><h1>Download</h1><table class="docTable"><tr><td><strong>Chapter 37</strong> CIVIL RIGHTS</td><td><a href="/Home/RenderDoc?objectName=mcl-chap37">HTML</a><a href="x.PDF">PDF</a></td></tr></table></main>'
    for n, h in (("a", act), ("s", sec), ("d", doc), ("u", "<main>nothing</main>")):
        (tmp_path / f"{n}.html").write_text(h)
    pages = site_pages(spark, str(tmp_path))
    by = {r.kind: r for r in pages.collect()}
    assert set(by) == {"act", "section", "document", "unknown"}
    assert (by["act"].act_label, by["act"].history, by["act"].next) == ("Act 175 of 1927", "1927, Act 175, Eff. Sept. 5, 1927", "mcl-act-1")
    assert (by["section"].number, by["section"].object_name, by["section"].next, by["section"].problem) == ("750.145p", "mcl-750-145p", "mcl-750-145q", None)
    assert (by["document"].heading, by["document"].title, by["document"].object_name, by["document"].pdf) == ("Chapter 37", "CIVIL RIGHTS", "mcl-chap37", "x.PDF")
    links = index_ranges(pages.where("kind = 'act'").select(F.inline("links"))).first()
    assert (links.first_citation, links.last_citation) == ("MCL 761.1", "MCL 762.16")
    assert parse_page('<div class="chapterHeading"><h1>Chapter 760</h1><h2>X</h2></div>')["kind"] == "chapter"


RSS = """<?xml version="1.0"?><rss><channel><title>T</title><lastBuildDate>Wed, 02 Sep 2026 10:00:00 GMT</lastBuildDate>
<item><title>Section 750.83 - amended</title><link>http://x/?objectName=mcl-750-83</link><description>Repealed. About.</description><pubDate>Wed, 02 Sep 2026 09:00:00 -0400</pubDate></item>
<item><title>Section 752.863[a] - added</title><guid>mcl-752-863-a</guid></item><item><title>Section Act.5.of.1950 - deleted</title></item><item><title>NORTHERN VETERAN - added</title><guid>mcl-447-2002-II</guid></item>
<item><title>Site notice</title></item></channel></rss>"""


TITLES = {
    "Section 750.83 has been amended": ("amended", "MCL 750.83", None, None), "Section 368.1978.5.55 - added": ("heading_added", None, "1978 PA 368", None),
    "Section 175.1927.II has been deleted": ("heading_deleted", None, "1927 PA 175", None), "Section 333.2026.amended - added": ("added", "MCL 333.2026", None, "amended"),
    "Section 5.474c[1]  -  moved to Code": ("moved_to_code", "MCL 5.474c", None, "[1]"), "Section Act.687.of.2002 has been deleted": ("act_deleted", None, "2002 PA 687", None),
    "Section E.R.O.No.1991.23 has been deleted": ("ero_deleted", None, None, None), "Section Initiated.Law.1.of.2018 - added": ("initiated_law_added", None, None, None),
    "Section 767A.1 - added": ("added", "MCL 767A.1", None, None), "Section Const-Article-IV-27 - added": ("unrecognized", None, None, None), "Chapter 750 was rebuilt": ("unrecognized", None, None, None),
    "Section 0.5 - added": ("unrecognized", None, None, None), "Section 750.83 added": ("unrecognized", None, None, None), "": ("unrecognized", None, None, None), None: ("unrecognized", None, None, None),
}


def test_titles_of_every_form(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string")
    got = {r.t: tuple(r.e) for r in df.select("t", fd.classify(F.col("t"), F.lit(None).cast("string")).alias("e")).collect()}
    assert got == TITLES
    df = spark.createDataFrame([("MENTAL HEALTH - SERVICES - added", "mcl-368-1978-2-23"), ("MENTAL HEALTH - added", None)], "t string, o string")
    got = [(r.e.kind, r.e.act_citation, r.h) for r in df.select(fd.classify(F.col("t"), F.col("o")).alias("e"), fd.heading(F.col("t"), F.col("o")).alias("h")).collect()]
    assert got == [("heading_added", "1978 PA 368", "MENTAL HEALTH - SERVICES"), ("unrecognized", None, None)]


def test_feeds_of_several_files(spark, tmp_path):
    """Each item has the build time of its own file; the closing sentence goes, what else is said stays."""
    for i, hint in ((1, "Expired. 1978, Act 368. Please see compilers notes or history at the bottom of the section for details."), (2, "Click here for fees")):
        (tmp_path / f"{i}.xml").write_text(RSS.replace("10:00:00", f"1{i}:00:00").replace("Repealed. About.", hint))
    got = {(r.feed_built_at, r.catchline_hint, r.status_hint) for r in rss_items(spark, str(tmp_path)).where("citation = 'MCL 750.83'").collect()}
    assert got == {("2026-09-02T11:00:00Z", "Expired. 1978, Act 368.", "expired"), ("2026-09-02T12:00:00Z", "Click here for fees", None)}
    s = summarize(rss_items(spark, str(tmp_path / "1.xml")))
    assert (s["items"], s["built_at"], s["by_kind"]["act_deleted"], s["chapters_touched"]) == (5, "2026-09-02T11:00:00Z", 1, {"750": 1, "752": 1})
    assert s["variant_nodes"] == ["MCL 752.863 [a]"] and s["act_level_events"] == ["1950 PA 5"] and s["acts_touched"] == ["1950 PA 5", "2002 PA 447"] and s["unrecognized_titles"] == ["Site notice"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.xml").write_text("<html><body/></html>")
    with pytest.raises(ValueError):
        rss_items(spark, str(tmp_path / "none"))


def test_feed_and_refresh(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    ev = rss_items(spark, str(tmp_path / "feed.xml"))
    by = {r.raw_title: r for r in ev.collect()}
    a = by["Section 750.83 - amended"]
    assert (a.kind, a.citation, a.status_hint, a.published, a.feed_built_at) == ("amended", "MCL 750.83", "repealed", "2026-09-02T13:00:00Z", "2026-09-02T10:00:00Z")
    assert (by["Section 752.863[a] - added"].variant, by["Section 752.863[a] - added"].object_name) == ("[a]", "mcl-752-863-a")
    assert by["Section Act.5.of.1950 - deleted"].kind == "act_deleted" and by["NORTHERN VETERAN - added"].kind == "heading_added" and by["Site notice"].kind == "unrecognized"
    assert {r.kind: r.n_events for r in fd.summary_by_kind(ev).collect()}["amended"] == 1
    store = Store(spark, str(tmp_path / "db"))
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "Chapter 750.xml").write_bytes(chapter("750", (*ACT, section("750.83"))))
    (tmp_path / "xml" / "Chapter 752.xml").write_bytes(chapter("752", (*ACT, section("752.863[a]"))))
    (tmp_path / "xml" / "Chapter 760.xml").write_bytes(chapter("760", (*ACT, section("760.1"))))
    feed = Feed(store)
    took = feed.take(ev)
    assert took["refetch_sections"] == ["MCL 750.83", "MCL 752.863"] and took["recrawl_acts"] == ["1950 PA 5", "2002 PA 447"] and took["unrecognized"] == ["Site notice"]
    assert took["refetch_objects"] == ["mcl-750-83", "mcl-752-863-a"]
    assert took["new_events"] == 5 and took["refresh_chapters"] == ["750", "752"] and took["unmapped_acts"] == ["1950 PA 5", "2002 PA 447"]
    with pytest.raises(FileNotFoundError):
        feed.refresh("mcl-xml-files", str(tmp_path / "db" / "feed"))  # fails: the plan stays pending
    assert feed.refresh("mcl-xml-files", str(tmp_path / "xml"))["docs_new"] == 2
    assert feed.refresh("mcl-xml-files", str(tmp_path / "xml")) is None
    assert feed.take(ev)["new_events"] == 0


def test_listing_and_plan(spark, tmp_path):
    (tmp_path / "l.html").write_text('<pre>9/21/2026  3:05 AM      1176978 <A HREF="/doc/Chapter%2037.xml">Chapter 37.xml</A><br> 2/6/2026  8:12 PM  12 <A HREF="/doc/Chapter%205A.xml">x</A><br> 1/1/2020 12:00 AM &lt;dir&gt; <A HREF="/doc/archive/">archive</A><br></pre>')
    e = directory_listing(spark, str(tmp_path / "l.html"))
    assert [(r.chapter, r.size, r.modified) for r in chapter_files(e).collect()] == [("5A", 12, "2026-02-06T20:12"), ("37", 1176978, "2026-09-21T03:05")]
    assert [r.name for r in e.where("is_dir").collect()] == ["archive"]
    known = spark.createDataFrame([("a", 1, "t", "h"), ("b", 1, "t", "h"), ("c", 1, "t", None), ("d", 1, "t", "h")], "name string, size bigint, modified string, sha256 string")
    listed = spark.createDataFrame([("a", 1, "t"), ("b", 2, "t"), ("c", 1, "t"), ("e", 1, "t")], "name string, size bigint, modified string")
    assert {r.name: r.action for r in plan_fetch(known, listed, ["name"]).collect()} == {"a": "unchanged", "b": "fetch", "c": "fetch", "d": "vanished", "e": "fetch"}


def test_bill_report(spark, tmp_path):
    (tmp_path / "b.html").write_text('<main><form><input name="dateFrom" value="2026-01-01"></form><h3>Introduced</h3><table><tbody><tr><td><a href="?objectName=2026-HB-4001">HB 4001</a></td><td>Amends MCL 750.1</td></tr></tbody></table></main>')
    r = bill_report(spark, str(tmp_path)).first()
    assert (r.stage, r.year, r.type, r.number, r.description, r.date_from) == ("Introduced", 2026, "HB", 4001, "Amends MCL 750.1", "2026-01-01")


def test_currency_stamp_anywhere_on_the_page(spark, tmp_path):
    page = lambda n, head, tail: f"""<html><body>{head}<div class="chapterWrapper"><div class="chapterHeading"><h1>Chapter {n}</h1><h2>CODE</h2></div>
    <div class="statuteWrapper"><div class="statuteHeading"><h1>THE CODE</h1><h2>Act 328 of 1931</h2></div>{WRAP.format(n=f"{n}.1", catch="Short title.")}</div></div>{tail}</body></html>"""  # noqa: E731
    stamp, long = "<p>Michigan Compiled Laws Complete\nThrough PA {} of {}</p>", f"<footer>{'Words behind it. ' * 400}</footer>"
    (tmp_path / "a.html").write_text(page("750", stamp.format(12, 2025), long))
    (tmp_path / "b.html").write_text(page("751", "", stamp.format(91, 2026)))
    (tmp_path / "c.html").write_text(page("752", "", long))
    assert get_source(spark, "mcl-files", str(tmp_path)).currency == "Michigan Compiled Laws Complete Through PA 12 of 2025"
    assert [r["text"] for r in ch.html_rows(page("753", "<b>Complete Through</b><i>PA 7 of 2024</i>", "")) if r["row"] == "chapter"] == ["Complete Through PA 7 of 2024"]
    assert [r["text"] for r in ch.html_rows(page("754", "", long)) if r["row"] == "chapter"] == [None]
