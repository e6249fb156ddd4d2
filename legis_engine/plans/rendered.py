"""Queries of the parsers: the tables' whole texts are written as markup, parsed and turned into records
again, while the SQL works out the records from the tables. Problem rows are part of the result."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions.citations import collapse
from ..operators.manifest import listing_entries
from ..operators import merge as mg
from ..session import reliable, shared_dir, ship
from ..sources import chapters as ch
from ..sources import pages as pg
from ..sources.loaders import rss_items
from ..store import ACTS, RANGES
from .catalog import _KEY, _SPACES, query, removed_ranges, roman, table
from .data_queries import _cite

SITE = "https://site.example/"
# Signs that no XML document can hold.
_NO_XML = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]"


def esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag(name: str, *inner: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), *[F.coalesce(c, F.lit("")) for c in inner], F.lit(f"</{name}>"))


def _words(sql: str) -> str:
    return f"trim(regexp_replace(coalesce({sql}, ''), '{_SPACES}', ' ', 'g'))"


# What the parsers should make of a document. A quarter is repealed; lines lose outer and repeated white space and empty
# ones go; the first line has a number before it and a table stands at the end.
_LINES = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '{_NO_XML}', ' ', 'g'), chr(10)), lambda x: {_words('x')}), lambda x: x <> '')"
_SUFFIX = "CASE WHEN v LIKE '[%' THEN v WHEN v <> '' THEN '-' || v ELSE '' END"
_BASE = f"""(SELECT *, coalesce(variant, '') AS v, doc_id % 4 = 0 AS gone, {_LINES} AS lines,
coalesce('Act ' || split_part(act_citation, ' ', 3) || ' of ' || substr(act_citation, 1, 4), '') AS label FROM documents)"""
_NAME = f"coalesce(nullif({_words('act_name')}, ''), label)"


def mcl_docs(spark, d) -> DataFrame:
    fits = F.coalesce("variant", F.lit("")).rlike(r"^([a-z]*|\[[A-Za-z0-9]+\])$")
    docs = table(spark, d, "documents").where(F.col("source").isin("mcl", "const") & fits)
    v = F.coalesce("variant", F.lit(""))
    suffix = F.when(v.startswith("["), v).when(v != "", F.concat(F.lit("."), v)).otherwise("")
    art, sec = F.regexp_extract("citation", "art ([0-9]+)", 1), F.regexp_extract("citation", "§ (.+)$", 1)
    const = F.concat(F.when(art == "", "Schedule").otherwise(F.concat(F.lit("Article "), roman(art.try_cast("int")))), F.lit(" § "), sec)
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), _NO_XML, " ")
    return docs.select(
        "doc_id", "source", v.alias("v"), (F.col("doc_id") % 4 == 0).alias("gone"), F.when(F.col("source") == "const", const).otherwise(F.concat(F.substring("citation", 5, 99), suffix)).alias("number"),
        F.coalesce(F.concat(F.lit("Act "), F.substring_index("act_citation", " ", -1), F.lit(" of "), F.substring("act_citation", 1, 4)), F.lit("")).alias("label"),
        "act_name", "citation", F.filter(F.split(clean, "\n"), lambda x: collapse(x) != "").alias("lines"),
    )


def _parsed(rendered: DataFrame, parse) -> DataFrame:
    """ROWS of markup held in the column ``page``; a page that cannot be parsed gives a problem row."""
    ship(rendered.sparkSession)

    def run(frames):
        for f in frames:
            rows = []
            for i, x in zip(f["doc_id"], f["page"], strict=True):
                try:
                    rows += [r | {"file": str(i)} for r in parse(x)]
                except Exception as e:  # noqa: BLE001
                    rows.append(ch._row(row="section", number="", message=f"cannot be parsed: {e}") | {"file": str(i)})
            yield pd.DataFrame(rows, columns=ch._COLUMNS).astype({"seq": "Int32", "multi": "boolean", "repealed": "boolean"})

    return rendered.select("doc_id", "page").mapInPandas(run, ch.ROWS)


def _records(rows: DataFrame) -> DataFrame:
    return ch.records(rows, SITE).select(
        F.col("file").cast("bigint").alias("doc_id"), "source", "citation", "variant", "chapter", F.nullif("act_citation", F.lit("")).alias("act_citation"), "act_name", "catchline", "text",
        "history_note", "compilers_notes", "status", "effective_date", "url", "path", "problem",
    )


_HISTORY = "1931, Act 328, Eff. Sept. 18, 1931"
_GONE = "Repealed. 1964, Act 1, Eff. Jan. 1, 1965."


def _record(chapter: str, name: str, text: str, history: str, path: str, where: str) -> str:
    return f"""
SELECT doc_id, source, citation, v AS variant, {chapter} AS chapter, act_citation, {name} AS act_name,
CASE WHEN gone THEN '{_GONE}' ELSE 'About it.' END AS catchline, {text} AS text, {history} AS history_note,
'Compiler''s Notes: Former text & more.' || CASE WHEN v <> '' AND source <> 'const' THEN chr(10) || 'Site notice: EFFECTIVE OCTOBER 1, 2026' ELSE '' END AS compilers_notes,
CASE WHEN gone THEN 'repealed' ELSE 'active' END AS status, CASE WHEN v <> '' AND source <> 'const' THEN '2026-10-01' WHEN gone THEN '1965-01-01' END AS effective_date,
'{SITE}' || CASE WHEN source = 'const' THEN 'mcl-chap1' ELSE 'mcl-' || replace(substr(citation, 5), '.', '-') || {_SUFFIX} END AS url, '{path}' AS path, CAST(NULL AS VARCHAR) AS problem
FROM {_BASE} WHERE {where} AND regexp_matches(v, '^([a-z]*|\\[[A-Za-z0-9]+\\])$')"""


_XML_TEXT = f"array_to_string(list_concat(CASE WHEN len(lines) > 0 THEN ['(1) ' || lines[1]] ELSE ['(1)'] END, lines[2:], ['a & b | ' || {_words('citation')}]), chr(10))"


@query(_record(
    chapter="CASE WHEN source = 'const' THEN '1' ELSE regexp_extract(citation, '^MCL ([0-9]+[A-Z]?)', 1) END", name=_NAME, text=_XML_TEXT,
    history=f"'{_HISTORY} ;-- Am. ' || (1950 + doc_id % 50) || ', Act 7'", path="Chapter I/Part 2 Fees & more", where="source IN ('mcl', 'const')",
))
def xml_roundtrip(spark, d):
    """Statute sections and the constitution as chapter files: whole texts in numbered paragraphs with a table, two
    nested divisions, notes, a banner on variants, a status in the catchline."""
    docs = mcl_docs(spark, d)
    paragraphs = F.array_join(F.transform("lines", lambda x, i: tag("P", esc(x))), "")
    body = F.concat(
        F.lit("<Section-Body><Paragraph><Paragraph-Number>(<Emph>1</Emph>)</Paragraph-Number>"), paragraphs, F.lit("</Paragraph>"),
        tag("table", tag("tr", tag("td", F.lit("a &amp; b")), tag("td", esc(F.col("citation"))))), F.lit("</Section-Body>"),
    )
    history = F.concat(F.lit(f"<HistoryData>{_HISTORY}</HistoryData><HistoryData>Am. "), (F.col("doc_id") % 50 + 1950).cast("string"), F.lit(", Act 7</HistoryData>"))
    note = tag("EditorsNotes", tag("EditorsNoteInfo", F.lit("<Type>Compiler</Type>"), tag("Text", F.lit("Former  text &amp;amp; more."))))
    banner = tag("Commentary", tag("CommentaryInfo", tag("Text", F.when(F.col("v") != "", "EFFECTIVE OCTOBER 1, 2026"))))
    sec = tag(
        "MCLSectionInfo", tag("MCLNumber", F.col("number")), tag("SectRef", F.col("number")), tag("CatchLine", F.when(F.col("gone"), _GONE).otherwise("About it.")),
        tag("Repealed", F.col("gone").cast("string")), tag("HistoryText", esc(history)), note, banner, tag("BodyText", esc(body)),
    )
    inner = lambda c: tag("MCLDocumentInfoCollection", c)
    part = tag("MCLDivisionInfo", F.lit("<DivisionType>Part</DivisionType><DivisionNumber>2</DivisionNumber><DivisionTitle>Fees &amp; more</DivisionTitle>"), inner(sec))
    chapter = tag("MCLDivisionInfo", F.lit("<DivisionType>Chapter</DivisionType><DivisionNumber>I</DivisionNumber>"), inner(part))
    name = F.regexp_replace(F.coalesce("act_name", F.lit("")), _NO_XML, " ")
    statute = tag("MCLStatuteInfo", tag("Name", F.col("label")), tag("Heading", esc(name)), inner(chapter), attrs=' xmlns="http://x.example"')
    page = tag("MCLChapterInfo", F.lit("<Name>1</Name><MultiChapter>true</MultiChapter>"), inner(statute))
    return _records(_parsed(docs.withColumn("page", page), ch.xml_rows))




@query(_record(
    chapter="regexp_extract(citation, '^MCL ([0-9]+[A-Z]?)', 1)", name=_words("act_name"), text=f"array_to_string(list_concat(lines, ['a & b | ' || {_words('citation')}, 'Loose end.']), chr(10))",
    history=f"'{_HISTORY}'", path="Chapter I/Part 2", where="source = 'mcl'",
))
def html_roundtrip(spark, d):
    """Statute sections as chapter pages: whole texts in paragraphs, a table with loose text behind it, nested divisions,
    labelled notes and a banner on variants."""
    docs = mcl_docs(spark, d).where("source = 'mcl'")
    box = lambda cls, *inner: tag("div", *inner, attrs=f' class="{cls}"')
    body = F.concat(
        F.array_join(F.transform("lines", lambda x: tag("p", esc(x))), ""),
        F.lit("<p><table><tr><td>a &amp; b</td><th>"), esc(F.col("citation")), F.lit("</th></tr></table>Loose end.</p>"),
    )
    head = tag("h1", F.col("number"), F.lit(" "), F.when(F.col("gone"), _GONE).otherwise("About it."), attrs=' class="h4"')
    notes = box("editorials", F.lit(f"<p><b>History:</b> {_HISTORY}</p><p><b>Compiler's Notes:</b> Former  text &amp; more.</p>"))
    banner = F.when(F.col("v") != "", box("commentary", F.lit("EFFECTIVE OCTOBER 1, 2026")))
    excerpt = box("excerpt", tag("h1", esc(F.col("act_name")), F.lit(" (EXCERPT)"), attrs=' class="h2"'), tag("h1", F.col("label"), attrs=' class="h3"'))
    sec = box("sectionWrapper", excerpt, head, banner, body, notes)
    part = box("divisionWrapper", F.lit('<div class="divisionHeading">Part 2</div>'), sec)
    chapter = box("divisionWrapper", F.lit('<div class="divisionHeading">Chapter I</div>'), part)
    statute = box("statuteWrapper", box("statuteHeading", tag("h1", esc(F.col("act_name"))), tag("h2", F.col("label"))), chapter)
    heading = box("chapterHeading", tag("h1", F.lit("Chapter "), F.regexp_extract("citation", "^MCL ([0-9]+[A-Z]?)", 1)), F.lit("<h2>CODE</h2>"))
    page = tag("html", tag("body", box("chapterWrapper", heading, statute)))
    return _records(_parsed(docs.withColumn("page", page), ch.html_rows))


@query(f"""SELECT doc_id, 'section' AS kind, 'mcl-' || replace(substr(citation, 5), '.', '-') AS object_name, substr(citation, 5) AS number, array_to_string(list_concat(lines, ['a & b | ' || {_words("citation")}]), chr(10)) AS text,
'{_HISTORY}' AS history, 'mcl-next-' || doc_id AS next_object, 'Michigan Compiled Laws Complete Through PA ' || (doc_id % 90 + 1) || ' of 2026' AS currency, CAST(NULL AS VARCHAR) AS problem
FROM {_BASE} WHERE source = 'mcl' AND v = ''""")
def page_sections(spark, d):
    """Ordinary sections as pages of the site, with their links and the currency stamp."""
    docs = mcl_docs(spark, d).where("source = 'mcl' and v = ''")
    body = F.concat(F.array_join(F.transform("lines", lambda x: tag("p", esc(x))), ""), F.lit("<table><tr><td>a &amp; b</td><td>"), esc(F.col("citation")), F.lit("</td></tr></table>"))
    obj = F.concat(F.lit("mcl-"), F.replace("number", F.lit("."), F.lit("-")))
    link = lambda o, name: F.concat(F.lit('<a href="/Laws/MCL?objectName='), o, F.lit(f'">{name}</a>'))
    sec = tag("div", tag("h1", F.col("number"), F.lit(" About it."), attrs=' class="h4"'), body, F.lit(f'<div class="editorials"><p><b>History:</b> {_HISTORY}</p></div>'), attrs=' class="sectionWrapper"')
    stamp = F.concat(F.lit("<footer>Laws Complete  Through PA "), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(" of 2026</footer>"))
    page = tag("html", tag("main", sec, link(obj, "Download Section"), link(F.concat(F.lit("mcl-next-"), F.col("doc_id").cast("string")), "Next Section")), stamp)
    ship(spark)

    def run(frames):
        for f in frames:
            yield pd.DataFrame([{"doc_id": i} | {("next_object" if k == "next" else k): r.get(k) for k in keys} for i, x in zip(f["doc_id"], f["page"], strict=True) for r in [pg.parse_page(x)]], columns=["doc_id", *names])

    keys = ["kind", "object_name", "number", "text", "history", "next", "currency", "problem"]
    names = ["next_object" if k == "next" else k for k in keys]
    return docs.select("doc_id", page.alias("page")).mapInPandas(run, "doc_id bigint, " + ", ".join(f"{n} string" for n in names))


@query("""SELECT c_custkey, 'Passed in the House' AS stage, '2025-HB-' || (4000 + c_custkey % 1000) AS object_name, 'HB ' || (4000 + c_custkey % 1000) AS label, 2025 AS year, 'HB' AS type, CAST(4000 + c_custkey % 1000 AS INTEGER) AS number,
'Fees; amends MCL ' || (c_custkey % 700 + 1) || '.' || c_custkey || ' & more.' AS description, '2025-01-0' || (c_nationkey % 9 + 1) AS date_from, 'MCL ' || (c_custkey % 700 + 1) || '.' || c_custkey AS section FROM customer WHERE c_custkey < 100000""")
def bill_reports(spark, d):
    """Reports of pending bills, one per customer, with the sections their descriptions name."""
    from ..operators.bills import with_targets

    n = F.col("c_custkey")
    cite = F.concat((n % 700 + 1).cast("string"), F.lit("."), n.cast("string"))
    bill = (n % 1000 + 4000).cast("string")
    row = tag("tr", F.concat(F.lit('<td><a href="/Bills/Bill?ObjectName=2025-HB-'), bill, F.lit('">HB '), bill, F.lit("</a></td>")), tag("td", F.lit("Fees; amends MCL "), cite, F.lit(" &amp; more.")))
    dates = F.concat(F.lit('<input name="dateFrom" value="2025-01-0'), (F.col("c_nationkey") % 9 + 1).cast("string"), F.lit('">'))
    page = tag("main", dates, F.lit("<h3>Passed  in the House</h3>"), tag("table", F.lit("<tr><th>Bill</th><th>Text</th></tr>"), row), F.lit("<table><tr><td>not a stage's</td></tr></table>"))
    ship(spark)
    names = [c for c in pg._BILL_COLUMNS if c not in ("file", "date_to")]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([{"c_custkey": i} | {k: r[k] for k in names} for i, x in zip(f["c_custkey"], f["page"], strict=True) for r in pg.parse_bill_report(x)], columns=["c_custkey", *names])

    schema = "c_custkey bigint, stage string, object_name string, label string, year int, type string, number int, description string, date_from string"
    # Five digits are the longest section number there is.
    rows = table(spark, d, "customer").where("c_custkey < 100000").select("c_custkey", page.alias("page")).mapInPandas(run, schema)
    return with_targets(rows).withColumn("section", F.array_join("sections", ",")).select("c_custkey", *names, "section")


@query("""WITH f AS (SELECT name AS path, regexp_extract(name, '[^/]+$') AS name, max(size) AS size, max(run_id) AS run_id FROM source_files WHERE size IS NOT NULL AND source = 'mcl' GROUP BY 1, 2)
SELECT path, name, size, '2026-0' || (run_id % 9 + 1) || '-1' || (run_id % 10) || 'T' || lpad(CAST(CASE WHEN run_id % 2 = 0 THEN run_id % 12 ELSE run_id % 12 + 12 END AS VARCHAR), 2, '0') || ':05' AS modified,
nullif(upper(regexp_extract(name, '(?i)^Chapter ([0-9]+[a-z]?)\\.xml$', 1)), '') AS chapter FROM f""")
def listing_files(spark, d):
    """A directory listing page of all listed files, read back; folders and the way up are told apart."""
    f = table(spark, d, "source_files").where("size is not null and source = 'mcl'").groupBy("name").agg(F.max("size").alias("size"), F.max("run_id").alias("run_id"))
    r = F.col("run_id")
    hour = F.when(r % 12 == 0, 12).otherwise(r % 12).cast("string")
    line = F.concat(
        (r % 9 + 1).cast("string"), F.lit("/1"), (r % 10).cast("string"), F.lit("/2026  "), hour, F.lit(":05 "), F.when(r % 2 == 0, "AM").otherwise("PM"), F.lit("   "), F.col("size").cast("string"),
        F.lit(' <A HREF="/files/'), F.replace("name", F.lit(" "), F.lit("%20")), F.lit('">'), F.col("name"), F.lit("</A><br>"),
    )
    up = F.lit('1/1/2026  9:00 AM  &lt;dir&gt; <A HREF="/files/..">up</A><br>1/1/2026  9:00 AM  &lt;dir&gt; <A HREF="/files/old/">old</A><br>')
    e = f.select(F.col("name").alias("path"), F.inline(listing_entries(F.concat(up, line)))).where(~F.col("is_dir"))
    return e.select("path", "name", "size", "modified", "chapter")


@query("""WITH e AS (SELECT DISTINCT event_id, feed_built_at, raw_title, object_name, kind, citation, act_citation, nullif(variant, '') AS variant FROM feed_events WHERE feed_built_at IS NOT NULL AND raw_title IS NOT NULL)
SELECT event_id, trim(regexp_replace(raw_title, '\\s+', ' ', 'g')) AS raw_title, object_name, feed_built_at, feed_built_at AS published, kind, citation, act_citation, variant,
CASE WHEN kind LIKE 'heading%' AND NOT starts_with(raw_title, 'Section ') THEN regexp_extract(raw_title, '^(.+?) - [A-Za-z ]+$', 1) ELSE 'Repealed. About & so on.' END AS catchline_hint,
CASE WHEN kind LIKE 'heading%' AND NOT starts_with(raw_title, 'Section ') THEN NULL ELSE 'repealed' END AS status_hint FROM e""")
def feed_rss(spark, d):
    """All events written as feeds to files and scanned: objects from links and bare identifiers, build times of each feed."""
    f = table(spark, d, "feed_events").where("feed_built_at is not null and raw_title is not null").select("event_id", "feed_built_at", "raw_title", "object_name").distinct()
    rfc = F.date_format(F.try_to_timestamp("feed_built_at", F.lit("yyyy-MM-dd'T'HH:mm:ssX")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    by_link = F.col("event_id") % 2 == 0
    link = F.when(by_link & F.col("object_name").isNotNull(), F.concat(F.lit("http://x.example/GetObject?event="), F.col("event_id").cast("string"), F.lit("&amp;objectName="), F.url_encode("object_name")))
    plain = F.concat(F.lit("http://x.example/?event="), F.col("event_id").cast("string"))
    guid = F.when(by_link | ~F.coalesce(F.col("object_name").startswith("mcl-"), F.lit(False)), "").otherwise(F.col("object_name"))
    hint = F.lit("Repealed.  About &amp; so on. Please see compilers notes or history at the bottom of the section for details.")
    item = tag("item", tag("title", esc(F.col("raw_title"))), tag("link", F.coalesce(link, plain)), tag("guid", esc(guid)), tag("description", hint), tag("pubDate", rfc))
    told = f.where(by_link | F.col("object_name").isNull() | F.col("object_name").startswith("mcl-"))
    # One feed, and file, per build: its items are what the site published at once.
    feeds = told.groupBy("feed_built_at").agg(F.array_join(F.collect_list(item), "").alias("items"))
    page = tag("rss", tag("channel", F.lit("<title>T</title>"), tag("lastBuildDate", rfc), F.col("items")))
    at = f"{shared_dir(spark).rstrip('/')}/tables/rss-{uuid.uuid4().hex}"
    feeds.select(page).write.option("maxRecordsPerFile", 1).text(at)
    event = F.regexp_extract("url", "event=([0-9]+)", 1).cast("bigint").alias("event_id")
    return rss_items(spark, at).select(event, "raw_title", "object_name", "feed_built_at", "published", "kind", "citation", "act_citation", "variant", "catchline_hint", "status_hint")




# --- spans, faults, stamps ------------------------------------------------------------------------------


@query("""WITH d AS (SELECT *, substr(citation, 5) AS n, regexp_extract(citation, '^MCL ([0-9]+[A-Z]?)', 1) AS ch FROM documents WHERE source = 'mcl' AND coalesce(variant, '') = '')
SELECT doc_id, 'MCL ' || ch || '.1' AS start_citation, CASE WHEN doc_id % 2 = 0 THEN 'MCL ' || ch || '.9a' ELSE 'MCL ' || ch || '.1' END AS end_citation, act_citation,
CASE doc_id % 3 WHEN 0 THEN 'repealed' WHEN 1 THEN 'rejected' ELSE 'reserved' END AS status, ch || '.1' || CASE WHEN doc_id % 2 = 0 THEN '-' || ch || '.9A' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN ' Repealed. 1940, Act 1.' WHEN 1 THEN ' Rejected by voters.' ELSE ' Reserved' END AS note FROM d
UNION ALL SELECT doc_id, 'MCL ' || ch || '.9x', 'MCL ' || ch || '.9x', act_citation, 'active', 'Compiled with ' || citation || ' (About it.)' FROM d WHERE n <> ch || '.9x'
UNION ALL SELECT doc_id, 'MCL ' || ch || '.7', 'MCL ' || ch || '.8', act_citation, 'expired', 'Former MCL ' || ch || '.7 to ' || ch || '.8, which pertained to fees, expired pursuant to its own terms' FROM d
UNION ALL SELECT doc_id, 'MCL ' || ch || '.3', 'MCL ' || ch || '.5', act_citation, 'repealed', 'being sections ' || ch || '.3, ' || ch || '.4 and ' || ch || '.5 of the Michigan Compiled Laws, are hereby repealed' FROM d""")
def chapter_ranges(spark, d):
    """Spans without live text that chapter files declare: stub lines, further numbers of a section, repeals in prose
    and announcements in notes."""
    docs = mcl_docs(spark, d).where("source = 'mcl' and v = ''").withColumn("c", F.regexp_extract("citation", "^MCL ([0-9]+[A-Z]?)", 1))
    c, i = F.col("c"), F.col("doc_id")
    stub = F.concat(
        c, F.lit(".1"), F.when(i % 2 == 0, F.concat(F.lit("-"), c, F.lit(".9A"))).otherwise(""), F.when(i % 3 == 0, " Repealed. 1940, Act 1.").when(i % 3 == 1, " Rejected by voters.").otherwise(" Reserved")
    )
    told = F.concat(F.lit("Act 1, being sections "), c, F.lit(".3, "), c, F.lit(".4 and "), c, F.lit(".5 of the Michigan Compiled Laws, are hereby repealed."))
    note = F.concat(F.lit("Former MCL "), c, F.lit(".7 to "), c, F.lit(".8, which pertained to fees, expired pursuant to its own terms."))
    sec = tag(
        "MCLSectionInfo", tag("MCLNumber", F.col("number")), tag("SectRef", F.col("number"), F.lit(", "), c, F.lit(".9x")), tag("CatchLine", F.lit("About it.")), tag("Repealed", F.lit("false")),
        tag("EditorsNotes", tag("EditorsNoteInfo", F.lit("<Type>Compiler</Type>"), tag("Text", note))), tag("BodyText", esc(tag("P", told))),
    )
    inner = lambda x: tag("MCLDocumentInfoCollection", x)
    statute = tag("MCLStatuteInfo", tag("Name", F.col("label")), tag("LongTitle", stub), inner(sec))
    page = tag("MCLChapterInfo", F.lit("<Name>1</Name><MultiChapter>true</MultiChapter>"), inner(statute))
    rows = _parsed(docs.withColumn("page", page), ch.xml_rows)
    r = ch.ranges(rows, ch.records(rows, SITE))
    file = F.coalesce("ordinal.file", F.lit(""))
    return r.select(file.cast("bigint").alias("doc_id"), "start_citation", "end_citation", F.nullif("act_citation", F.lit("")).alias("act_citation"), "status", "note")


@query("""WITH d AS (SELECT *, regexp_extract(citation, '^MCL ([0-9]+[A-Z]?)', 1) AS ch FROM documents WHERE source = 'mcl' AND coalesce(variant, '') = '')
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN citation || ' stands in chapter 999' WHEN 1 THEN citation || ': repealed flag disagrees with its catchline' WHEN 2 THEN 'section number not recognised: §' || ch
WHEN 3 THEN 'duplicate section ' || citation || ' ' WHEN 4 THEN 'cannot be parsed: no chapter name' END AS problem FROM d WHERE doc_id % 6 < 5""")
def chapter_problems(spark, d):
    """Faults that stop a crawl: a section of another chapter, a flag against its catchline, a number that is none, a
    section twice, a file without its chapter. Sound files (a sixth) report nothing."""
    docs = mcl_docs(spark, d).where("source = 'mcl' and v = ''").withColumns({"c": F.regexp_extract("citation", "^MCL ([0-9]+[A-Z]?)", 1), "k": F.col("doc_id") % 6})
    k = F.col("k")
    sec = tag("MCLSectionInfo", tag("MCLNumber", F.when(k == 2, F.concat(F.lit("§"), F.col("c"))).otherwise(F.col("number"))), tag("CatchLine", F.lit("About it.")), tag("Repealed", (k == 1).cast("string")), tag("BodyText", F.lit("Text.")))
    twice = F.when(k == 3, F.concat(sec, sec)).otherwise(sec)
    inner = lambda x: tag("MCLDocumentInfoCollection", x)
    name = F.when(k == 4, "").when(k == 0, "999").otherwise(F.col("c"))
    page = tag("MCLChapterInfo", tag("Name", name), F.lit("<MultiChapter>false</MultiChapter>"), inner(tag("MCLStatuteInfo", F.lit("<Name>Act 1 of 1999</Name>"), inner(twice))))
    rows = _parsed(docs.withColumn("page", page), ch.xml_rows)
    return ch.problems(rows, ch.records(rows, SITE)).select(F.col("file").cast("bigint").alias("doc_id"), "problem")


@query("""SELECT min_by('Michigan Compiled Laws Complete Through PA ' || (doc_id % 300 + 1) || ' of ' || (2000 + doc_id % 20), (2000 + doc_id % 20) * 1000 + doc_id % 300 + 1) AS currency FROM documents WHERE source = 'mcl' AND coalesce(variant, '') = ''""")
def currency_oldest(spark, d):
    """The least current of all pages' stamps, which stand at the head or the foot of whole texts."""
    docs = mcl_docs(spark, d).where("source = 'mcl' and v = ''")
    i = F.col("doc_id")
    stamp = F.concat(F.lit("<p>Michigan Compiled Laws  Complete Through PA "), (i % 300 + 1).cast("string"), F.lit(" of "), (i % 20 + 2000).cast("string"), F.lit("</p>"))
    body = F.array_join(F.transform("lines", lambda x: tag("p", esc(x))), "")
    page = F.concat(
        F.when(i % 2 == 0, stamp).otherwise(""), F.lit('<div class="chapterWrapper"><div class="chapterHeading"><h1>Chapter 5</h1></div><div class="statuteWrapper">'), body, F.lit("</div></div>"), F.when(i % 2 == 1, stamp).otherwise("")
    )
    return ch.oldest_currency(_parsed(docs.withColumn("page", page), ch.html_rows))


# --- references written from numbers ----------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 700 + 1 AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR) AS c,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem WHERE l_orderkey % 3 <> 0),
s AS (SELECT *, (l_orderkey + n) % 4 AS sep FROM l),
f AS (SELECT l_orderkey, 'MCL ' || c || 'b' AS key, n, (n > 1 AND lag(sep) OVER w >= 2) OR (n < m AND sep >= 2) AS r FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
SELECT l_orderkey, 'mcl' AS kind, key, arg_min(r, n) AS in_range FROM f GROUP BY l_orderkey, key
UNION ALL SELECT l_orderkey, 'const', CASE WHEN l_orderkey % 2 = 0 THEN 'Const 1963, art ' || (l_orderkey % 12 + 1) ELSE 'Const 1963, Schedule' END || ', § ' || (l_orderkey % 40 + 1) || 'a', FALSE FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def xref_being(spark, d):
    """Chains led in by "being sections" (a third lacks what must follow and is none), and the constitution in both orders,
    with roman and plain articles and the schedule."""
    from ..functions.xrefs import extract_xrefs

    o = F.col("l_orderkey")
    sep = lambda n: F.element_at(F.array(*[F.lit(x) for x in (" & ", ", or ", " – ", "  through\n")]), (o + n).cast("int") % 4 + 1)
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    cite = lambda c: F.concat((c % 700 + 1).cast("string"), F.lit("."), c.cast("string"), F.lit("B(1)(a)"))
    chain = F.array_join(F.transform("x", lambda r, i: F.concat(cite(r["l_partkey"]), F.when(i + 1 < F.size("x"), sep(i + 1)).otherwise(""))), "")
    after = F.when(o % 3 == 0, " of another code").otherwise(" of the Michigan  Compiled Laws")
    art = (o % 12 + 1).cast("int")
    place = F.when(o % 2 == 1, "Schedule").when(o % 4 == 0, F.concat(F.lit("art. "), roman(art))).otherwise(F.concat(F.lit("article "), art.cast("string")))
    const = F.concat(F.when(o % 5 == 0, "1963 Const").otherwise("Const. 1963"), F.lit(", "), place, F.lit(", § "), (o % 40 + 1).cast("string"), F.lit("A"))
    text = F.concat(F.lit("Being  sections "), chain, after, F.lit("; see "), const, F.lit("."))
    return extract_xrefs(items.select("l_orderkey", text.alias("text")), "l_orderkey", "text").select("l_orderkey", "kind", "key", "in_range")


# --- the merge's other tables -----------------------------------------------------------------------------


@query(f"""SELECT DISTINCT source, citation, CASE WHEN canonical IS NULL OR canonical <> citation THEN 'citation is not canonical' WHEN kind <> source THEN 'citation belongs to another source' ELSE 'source was not declared' END AS problem
FROM (SELECT *, CASE WHEN regexp_matches(k, '^(MCL|MCR|MRE|Const 1963,) ') THEN k END AS canonical, lower(regexp_extract(k, '^([A-Za-z]+)', 1)) AS kind
      FROM (SELECT DISTINCT regexp_replace(lower(to_kind), '[^a-z]', '', 'g') AS source, to_key AS citation, {_cite("to_key")} AS k FROM xrefs WHERE to_key IS NOT NULL AND to_kind IS NOT NULL))
WHERE canonical IS NULL OR canonical <> citation OR kind <> source OR source NOT IN ('mcl', 'mre')""")
def merge_violations(spark, d):
    """Keys as they are written in references, held against the store's contract: canonical, of their source, declared."""
    x = table(spark, d, "xrefs").where("to_key is not null and to_kind is not null")
    rows = x.select(F.regexp_replace(F.lower("to_kind"), "[^a-z]", "").alias("source"), F.col("to_key").alias("citation")).distinct()
    out = None
    for source in ("mcl", "mcr", "mre", "const", "publicact"):
        part = mg.violations(rows.where(F.col("source") == source), mg.Run(1, "1", kinds=["mcl", "mre"])).select(F.lit(source).alias("source"), "citation", "problem")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


_SPANS = f"""(SELECT chapter, min(ROW(n1, l1, n2, l2, citation)) AS lo, max(ROW(n1, l1, n2, l2, citation)) AS hi FROM (SELECT *, {_KEY} FROM documents WHERE NOT active AND source = 'mcl' AND coalesce(variant, '') = '' AND chapter IS NOT NULL) GROUP BY chapter)"""


@query(f"""WITH r AS (SELECT chapter, lo[5] AS start_citation, hi[5] AS end_citation, TRY_CAST(regexp_extract(chapter, '^[0-9]+') AS INTEGER) AS n FROM {_SPANS})
SELECT start_citation, end_citation, chapter, NOT (n % 2 = 0 AND n % 3 = 0) AS active, '1' AS first_seen, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN 'second' ELSE 'first' END AS note FROM r""")
def merge_ranges_scope(spark, d):
    """Removed spans upserted, then again for the even chapters, each twice and without every third: the last of repeated
    ones counts, the missing ones are deactivated, other chapters stay."""
    spans = removed_ranges(spark, d).where("chapter is not null").select(F.lit("mcl").alias("source"), "start_citation", "end_citation", "chapter", *[F.lit(None).cast("string").alias(c) for c in ("act_citation", "act_name", "status")])
    n = F.regexp_extract("chapter", "^[0-9]+", 0).try_cast("int")
    ranges = reliable(mg.merge_ranges(spark.createDataFrame([], RANGES), spans.withColumn("note", F.lit("first")), mg.Run(1, "1")))
    again = spans.where((n % 2 == 0) & (n % 3 != 0)).select("*", F.explode(F.array(F.struct(F.lit(2).alias("ordinal"), F.lit("second").alias("note")), F.struct(F.lit(1).alias("ordinal"), F.lit("zero").alias("note")))).alias("o")).select("*", "o.*").drop("o")
    scope = [r.chapter for r in spans.where(n % 2 == 0).select("chapter").distinct().collect()]  # chapters: some hundred
    return mg.merge_ranges(ranges, again, mg.Run(2, "2", chapters=scope)).select("start_citation", "end_citation", "chapter", "active", "first_seen", "note")


@query("""SELECT act_year AS year, act_number AS number, max_by(title, coalesce(recorded_at, '') || title) AS title, 'MCL 1.' || act_number || '; MRE 404' AS targets, CAST(count(*) FILTER (WHERE FALSE) AS BIGINT) AS lost FROM public_acts GROUP BY act_year, act_number""")
def merge_acts_upsert(spark, d):
    """Acts upserted with targets in any spelling; of repeated deliveries the last counts."""
    a = table(spark, d, "public_acts")
    cites = F.array(F.concat(F.lit("mcl  1."), F.col("act_number").cast("string"), F.lit("(2)(b)")), F.concat(F.lit("1."), F.col("act_number").cast("string")), F.lit("mre 404"))
    rows = a.select(F.struct(F.coalesce("recorded_at", F.lit("")), "title").alias("ordinal"), F.col("act_year").alias("year"), F.col("act_number").alias("number"), "title", "effective_date", "url", cites.alias("affected_citations"))
    stored = reliable(mg.merge_acts(spark.createDataFrame([], ACTS), rows.withColumn("title", F.lit("old"))))
    after = mg.merge_acts(stored, rows)
    lost = after.join(stored.select("year", "number", F.lit(True).alias("held")), ["year", "number"], "left")
    return lost.groupBy("year", "number", "title", F.array_join("affected_citations", "; ").alias("targets")).agg(F.count(F.when(F.col("held").isNull(), 1)).alias("lost"))
