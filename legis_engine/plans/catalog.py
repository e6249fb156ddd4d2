"""Driver queries of the engine's own operators over the test tables, with their SQL.

The corpus tables stand in for the store: documents (with text), versions, xrefs, runs,
public_acts, feed_events, history_entries, source_files and corpus_snapshots. Where a grammar is
under test and the tables hold the numbers only, the query renders the text and parses it back,
while the SQL computes the answer from the numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.citations import normalize_citation, roman_to_int, sort_key
from ..functions.history import parse_history
from ..functions.xrefs import chain_tokens, extract_xrefs, narrative_ranges, references_in, section_chains
from ..operators import feed as fd
from ..operators import manifest as mf
from ..operators import search as se
from ..operators import service as sv
from ..operators.bills import with_targets
from ..operators import merge as mg
from ..operators.merge import content_hash
from ..session import materialize, reliable, shared_dir
from .data_queries import _cite, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TOK = "regexp_extract_all(translate(lower(regexp_replace(coalesce({c}, ''), '\\p{{Mn}}+', '', 'g')), '" + se.ACCENTED + "', '" + se.BARE + "'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def _tokens_sql(column: str) -> str:
    """SQL giving the tokens of a column."""
    return _TOK.format(c=column)


def big(c: Column) -> Column:
    return c.cast("bigint")


# --- documents and versions -------------------------------------------------------------------

_VERSIONS = "(SELECT DISTINCT version_id, document_id, catchline, status, first_seen, content_hash FROM versions)"


def versions_once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "versions").select("version_id", "document_id", "catchline", "status", "first_seen", "content_hash").distinct()


@query(f"""
WITH v AS (SELECT *, max(first_seen || lpad(CAST(version_id AS VARCHAR), 20, '0')) OVER (PARTITION BY document_id) AS newest FROM {_VERSIONS}),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_seen DESC, version_id DESC, content_hash DESC, status DESC, catchline DESC) AS rn
      FROM v WHERE substr(first_seen, 1, 10) <= '2025-06-30')
SELECT document_id, version_id, content_hash, first_seen, first_seen || lpad(CAST(version_id AS VARCHAR), 20, '0') < newest AS superseded FROM r WHERE rn = 1""")
def doc_as_of(spark, d):
    """Each document as observed by a date, and whether a later version was seen since."""
    order = ["first_seen", "version_id"]
    rows = sv.as_of(versions_once(spark, d).groupBy("document_id", *order).agg(F.max("content_hash").alias("content_hash")), ["document_id"], order, sv.check_date("2025-06-30"))
    return rows.select("document_id", "version_id", "content_hash", "first_seen", "superseded")


@query("""
SELECT d.doc_id, d.citation, d.source, d.chapter, d.url, d.active, v.status, v.first_seen FROM documents d
JOIN (SELECT document_id, trim(regexp_replace(trim(lower(status)), '\\.+$', '')) AS status, first_seen,
             row_number() OVER (PARTITION BY document_id ORDER BY first_seen DESC, version_id DESC) AS rn FROM versions) v
  ON v.document_id = d.doc_id AND v.rn = 1 WHERE coalesce(d.variant, '') = ''""")
def doc_point_lookup(spark, d):
    """Every ordinary document with its latest version (a single key is a filter on this)."""
    from ..operators.satellites import clean_status

    v = table(spark, d, "versions").groupBy(F.col("document_id").alias("doc_id")).agg(
        F.max_by(F.struct(clean_status(F.col("status")).alias("status"), "first_seen"), F.struct("first_seen", "version_id")).alias("v")
    )
    docs = table(spark, d, "documents").where(F.coalesce("variant", F.lit("")) == "")
    return docs.join(v, "doc_id").select("doc_id", "citation", "source", "chapter", "url", "active", "v.status", "v.first_seen")


@query("""SELECT source, citation, count(*) AS n_forms, string_agg(variant, ',' ORDER BY variant) AS forms FROM documents
WHERE active AND coalesce(variant, '') <> '' GROUP BY source, citation""")
def doc_other_forms(spark, d):
    return sv.other_forms(table(spark, d, "documents"))


_RUNS = """(SELECT run_id, source, started_at, finished_at, complete_crawl, scope, source_currency, error, status FROM (
  SELECT run_id, source, started_at, finished_at, complete_crawl, scope, source_currency, error, lower(trim(status)) AS status,
         row_number() OVER (PARTITION BY run_id ORDER BY CASE lower(trim(status)) WHEN 'ok' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END DESC, coalesce(finished_at, '') DESC) AS rn
  FROM runs) WHERE rn = 1)"""


@query(f"""SELECT source, run_id, source_currency FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS k FROM {_RUNS} WHERE status = 'ok') WHERE k = 1""")
def provenance_latest_run(spark, d):
    return sv.provenance(sv.run_states(table(spark, d, "runs")))


@query(f"""
WITH r AS {_RUNS}, o AS (
  SELECT source,
         arg_max(finished_at, started_at || lpad(CAST(run_id AS VARCHAR), 9, '0')) FILTER (WHERE status = 'ok') AS last_successful_run,
         arg_max(source_currency, started_at || lpad(CAST(run_id AS VARCHAR), 9, '0')) FILTER (WHERE status = 'ok') AS source_currency,
         arg_max(finished_at, started_at || lpad(CAST(run_id AS VARCHAR), 9, '0')) FILTER (WHERE status = 'ok' AND complete_crawl AND scope IS NULL) AS last_full_crawl,
         arg_max(status, started_at || lpad(CAST(run_id AS VARCHAR), 9, '0')) AS last_run_status,
         arg_max(coalesce(error, chr(0)), started_at || lpad(CAST(run_id AS VARCHAR), 9, '0')) AS err
  FROM r GROUP BY source),
v AS (SELECT document_id, arg_max(run_id, first_seen || lpad(CAST(version_id AS VARCHAR), 20, '0')) AS run_id FROM versions GROUP BY document_id),
w AS (SELECT d.active, coalesce(d.variant, '') AS variant, r.source FROM documents d JOIN v ON v.document_id = d.doc_id JOIN r USING (run_id)),
d AS (SELECT source, sum(CASE WHEN active AND variant = '' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN NOT active AND variant = '' THEN 1 ELSE 0 END) AS x,
             sum(CASE WHEN active AND variant <> '' THEN 1 ELSE 0 END) AS f FROM w GROUP BY source)
SELECT coalesce(d.source, o.source) AS source, CAST(coalesce(a, 0) AS BIGINT) AS active_documents, CAST(coalesce(x, 0) AS BIGINT) AS removed_documents,
       CAST(coalesce(f, 0) AS BIGINT) AS extra_forms_listed, last_successful_run, source_currency, last_full_crawl, last_run_status,
       CASE WHEN last_run_status = 'failed' THEN nullif(err, chr(0)) END AS last_run_error
FROM d FULL JOIN o ON d.source = o.source""")
def data_status(spark, d):
    """Documents counted under the source of the run that made their latest version."""
    states = sv.run_states(table(spark, d, "runs"))
    made = table(spark, d, "versions").groupBy(F.col("document_id").alias("doc_id")).agg(F.max_by("run_id", F.struct("first_seen", "version_id")).alias("run_id"))
    docs = table(spark, d, "documents").select("doc_id", "active", F.coalesce("variant", F.lit("")).alias("variant"))
    return sv.data_status(docs.join(made, "doc_id").join(states.select("run_id", "source"), "run_id"), states)


# --- citations ----------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT to_key, {_cite("to_key")} AS canonical FROM xrefs
WHERE to_key IS NOT NULL AND regexp_replace(lower(to_kind), '[^a-z]', '', 'g') <> 'publicact'""")
def citation_normalize(spark, d):
    x = table(spark, d, "xrefs").where("to_key is not null").where(F.regexp_replace(F.lower("to_kind"), "[^a-z]", "") != "publicact")
    return x.select("to_key").distinct().select("to_key", normalize_citation(F.col("to_key")).alias("canonical"))


_KEY = """CASE WHEN source = 'const' THEN coalesce(TRY_CAST(regexp_extract(citation, 'art ([0-9]+)', 1) AS INTEGER), 9999)
     ELSE coalesce(TRY_CAST(regexp_extract(citation, '([0-9]+)', 1) AS INTEGER), 0) END AS n1,
CASE WHEN source = 'mcl' THEN regexp_extract(citation, '[0-9]([A-Z]?)\\.', 1) ELSE '' END AS l1,
CASE WHEN source = 'const' THEN CAST(regexp_extract(citation, '§ ([0-9]+)', 1) AS INTEGER)
     ELSE coalesce(TRY_CAST(regexp_extract(citation, '\\.([0-9]+)', 1) AS INTEGER), 0) END AS n2,
CASE WHEN source = 'const' THEN regexp_extract(citation, '§ [0-9]+([a-z]?)', 1) WHEN source IN ('mcl', 'mcr') THEN regexp_extract(citation, '\\.[0-9]+([a-z]*)', 1) ELSE '' END AS l2"""


@query(f"""SELECT doc_id, source, chapter, citation, row_number() OVER (PARTITION BY source, chapter ORDER BY n1, l1, n2, l2, citation) AS place
FROM (SELECT *, {_KEY} FROM documents WHERE active AND coalesce(variant, '') = '')""")
def chapter_outline(spark, d):
    """All chapters in natural order."""
    return sv.outline(table(spark, d, "documents")).select("doc_id", "source", "chapter", "citation", big(F.col("place")).alias("place"))


@query(f"""SELECT doc_id, citation, act_citation, act_name FROM (SELECT *, {_KEY} FROM documents
WHERE active AND coalesce(variant, '') = '' AND source = 'mcl' AND chapter = (SELECT chapter FROM documents WHERE source = 'mcl' GROUP BY chapter ORDER BY count(*) DESC, chapter LIMIT 1))
ORDER BY n1, l1, n2, l2, citation LIMIT 50 OFFSET 10""")
def chapter_outline_page(spark, d):
    """The second page of the largest chapter."""
    docs = table(spark, d, "documents")
    top = docs.where("source = 'mcl'").groupBy("chapter").count().orderBy(F.desc("count"), "chapter").first()
    return sv.outline_page(docs, f"chapter {top.chapter if top else ''}", offset=10, limit=50).select("doc_id", "citation", "act_citation", "act_name")


@query(f"SELECT doc_id, n1, l1, n2, l2 FROM (SELECT doc_id, {_KEY} FROM documents)")
def citation_sort(spark, d):
    return table(spark, d, "documents").select("doc_id", sort_key(F.col("citation")).alias("k")).select("doc_id", "k.*")


def roman(n: Column) -> Column:
    """A number below 400 in roman letters."""
    digits = lambda v, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), v + 1)
    return F.concat(F.repeat(F.lit("C"), F.floor(n / 100).cast("int")), digits(F.floor(n / 10).cast("int") % 10, "X", "L", "C"), digits(n % 10, "I", "V", "X"))


@query("SELECT DISTINCT CAST(p_size AS INTEGER) AS n, CAST(p_size AS INTEGER) AS parsed FROM part WHERE p_size BETWEEN 1 AND 399")
def citation_const_roman(spark, d):
    """Numbers rendered as roman articles and read back."""
    return table(spark, d, "part").select(F.col("p_size").cast("int").alias("n")).distinct().where("n between 1 and 399").select("n", roman_to_int(roman(F.col("n"))).alias("parsed"))


# --- references -----------------------------------------------------------------------------------


def _part_cite(c: Column) -> Column:
    return F.concat((c % 700 + 1).cast("string"), F.lit("."), c.cast("string"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 700 + 1 AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR) AS c,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
s AS (SELECT *, (l_orderkey + n) % 5 AS sep FROM l),
f AS (SELECT l_orderkey, 'MCL ' || c AS key, n, (n > 1 AND lag(sep) OVER w = 2) OR (n < m AND sep = 2) AS r FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
SELECT l_orderkey, key, arg_min(r, n) AS in_range FROM f GROUP BY l_orderkey, key""")
def xref_extract(spark, d):
    """One chain per order with every separator, a chapter-zero decimal after it, read back."""
    sep = lambda n: F.element_at(F.array(*[F.lit(x) for x in (", ", ", and ", " to ", " & ", " or ")]), (F.col("l_orderkey") + n).cast("int") % 5 + 1)
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    parts = F.transform("x", lambda r, i: F.concat(_part_cite(r["l_partkey"]), F.when(i + 1 < F.size("x"), sep(i + 1)).otherwise("")))
    text = F.concat(F.lit("As provided in MCL "), F.array_join(parts, ""), F.lit(", 0.02 of the limit applies."))
    return extract_xrefs(items.select("l_orderkey", text.alias("text")), "l_orderkey", "text").select("l_orderkey", "key", "in_range")


@query("""
SELECT doc_id, kind, key, count(*) AS n FROM (
  SELECT DISTINCT doc_id, 'public_act' AS kind, regexp_extract(r, '([0-9]{4})$', 1) || ' PA ' || CAST(CAST(regexp_extract(r, '(?i)Act\\s+(?:No\\.\\s+)?([0-9]+)', 1) AS INTEGER) AS VARCHAR) AS key, r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\bAct\\s+(?:No\\.\\s+)?[0-9]{1,4}\\s+of\\s+(?:the\\s+Public\\s+Acts\\s+of\\s+)?[0-9]{4}\\b')) AS r FROM documents)
  UNION ALL
  SELECT DISTINCT doc_id, 'public_act', regexp_extract(r, '^([0-9]{4})', 1) || ' PA ' || CAST(CAST(regexp_extract(r, '([0-9]+)$', 1) AS INTEGER) AS VARCHAR), r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{4}\\s+PA\\s+[0-9]{1,4}\\b')) AS r FROM documents)
  UNION ALL
  SELECT DISTINCT doc_id, 'mcr', upper(regexp_replace(r, '\\s+', ' ')), r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\bMCR\\s+[0-9]{1,2}\\.[0-9]{1,3}[A-Za-z]?')) AS r FROM documents)
  UNION ALL
  SELECT DISTINCT doc_id, 'mre', regexp_replace(r, '\\s+', ' '), r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\bMRE\\s+[0-9]{3,4}')) AS r FROM documents))
GROUP BY doc_id, kind, key""")
def xref_documents(spark, d):
    """Acts and court rules cited in the texts themselves."""
    refs = extract_xrefs(table(spark, d, "documents"), "doc_id", "text", kinds=("public_act", "mcr", "mre"))
    return refs.groupBy("doc_id", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\bMCL\\s+0*[1-9][0-9]{0,2}[A-Za-z]?\\.[0-9]{1,5}')) AS r FROM documents) GROUP BY doc_id""")
def xref_chains(spark, d):
    """Chains that start with a section, per document, as the operator finds them."""
    return table(spark, d, "documents").select("doc_id", big(F.size(section_chains(F.col("text")))).alias("n")).where("n > 0")


@query()
def xref_documents_all(spark, d):
    """All references of the texts, of every kind, with the members of section chains."""
    return extract_xrefs(table(spark, d, "documents"), "doc_id", "text")


_SECTIONS = """SELECT CAST(l_orderkey AS VARCHAR) AS id, l_orderkey, min(l_partkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY l_orderkey"""


@query(f"""SELECT l_orderkey, 'MCL ' || (a % 700 + 1) || '.' || a AS start_citation, 'MCL ' || (b % 700 + 1) || '.' || b AS end_citation,
CASE WHEN l_orderkey % 2 = 0 THEN 'repealed' ELSE 'expired' END AS status FROM ({_SECTIONS})""")
def narrative_ranges_query(spark, d):
    """Repeals in prose (even orders) and announcements in notes (odd ones), read back."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_suppkey").alias("b"))
    span = F.concat(_part_cite(F.col("a")), F.lit(" to "), _part_cite(F.col("b")))
    even = F.col("l_orderkey") % 2 == 0
    text = F.when(even, F.concat(F.lit("Act 1 of 1931, being sections "), span, F.lit(" of the Michigan Compiled Laws, are hereby repealed.")))
    notes = F.when(~even, F.concat(F.lit("Former MCL "), span, F.lit(", which pertained to fees, expired pursuant to its own terms.")))
    return x.select("l_orderkey", F.inline(narrative_ranges(text, notes))).select("l_orderkey", "start_citation", "end_citation", "status")


_X = f"""(SELECT DISTINCT xref_id, from_document_id AS from_id, regexp_replace(lower(to_kind), '[^a-z]', '', 'g') AS kind, {_cite("to_key")} AS key, in_range FROM xrefs WHERE to_key IS NOT NULL)"""


def refs_once(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.orphans import references

    x = table(spark, d, "xrefs")
    return references(x).select("xref_id", "kind", "key").join(x.select("xref_id", F.col("from_document_id").alias("from_id"), "in_range").distinct(), "xref_id")


@query(f"""SELECT x.xref_id, x.from_id, x.kind, x.key, x.in_range, d.doc_id AS target_id, d.doc_id IS NOT NULL AS in_database FROM {_X} x
LEFT JOIN documents d ON d.source = x.kind AND d.citation = x.key AND d.active AND coalesce(d.variant, '') = ''""")
def xref_cites(spark, d):
    return sv.cites(refs_once(spark, d), table(spark, d, "documents")).select("xref_id", "from_id", "kind", "key", "in_range", "target_id", "in_database")


@query(f"""SELECT x.kind, x.key, count(*) AS n_refs, count(DISTINCT x.from_id) AS n_documents, min(d.citation) AS first_citing FROM {_X} x
JOIN documents d ON d.doc_id = x.from_id AND d.active AND coalesce(d.variant, '') = '' GROUP BY x.kind, x.key""")
def xref_cited_by(spark, d):
    return sv.cited_by(refs_once(spark, d), table(spark, d, "documents")).groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("from_id").alias("n_documents"), F.min("citing").alias("first_citing")
    )


@query(f"""SELECT coalesce(o.from_id, i.doc_id) AS doc_id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM
(SELECT from_id, count(*) AS n_out FROM {_X} GROUP BY from_id) o FULL JOIN
(SELECT d.doc_id, count(*) AS n_in FROM {_X} x JOIN documents d ON d.source = x.kind AND d.citation = x.key AND d.active AND coalesce(d.variant, '') = '' GROUP BY d.doc_id) i
ON o.from_id = i.doc_id""")
def xref_degree(spark, d):
    refs = refs_once(spark, d)
    out = refs.groupBy(F.col("from_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = sv.cites(refs, table(spark, d, "documents")).where("in_database").groupBy(F.col("target_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "doc_id", "full_outer").select("doc_id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def removed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Per chapter the span of its removed sections, by natural order."""
    k = F.struct(sort_key(F.col("citation")).alias("k"), "citation")
    gone = table(spark, d, "documents").where(~F.col("active") & (F.col("source") == "mcl") & (F.coalesce("variant", F.lit("")) == ""))
    return gone.groupBy("chapter").agg(F.min(k)["citation"].alias("start_citation"), F.max(k)["citation"].alias("end_citation"))


@query(f"""
WITH k AS (SELECT *, {_KEY} FROM documents WHERE NOT active AND source = 'mcl' AND coalesce(variant, '') = ''),
r AS (SELECT chapter, min(ROW(n1, l1, n2, l2)) AS lo, max(ROW(n1, l1, n2, l2)) AS hi FROM k GROUP BY chapter),
m AS (SELECT x.key, x.kind AS source, x.key AS citation FROM {_X} x LEFT JOIN documents d ON d.source = x.kind AND d.citation = x.key AND d.active AND coalesce(d.variant, '') = ''
      WHERE d.doc_id IS NULL AND x.kind = 'mcl'),
u AS (SELECT key, count(*) AS n_refs, any_value(source) AS source, any_value(citation) AS citation FROM m GROUP BY key),
t AS (SELECT key, n_refs, {_KEY} FROM u)
SELECT key, n_refs, r.chapter FROM t LEFT JOIN r ON ROW(n1, l1, n2, l2) >= r.lo AND ROW(n1, l1, n2, l2) <= r.hi""")
def xref_range_resolution(spark, d):
    """Unresolved section references and the removed spans they fall in."""
    missing = sv.cites(refs_once(spark, d), table(spark, d, "documents")).where(~F.col("in_database") & (F.col("kind") == "mcl"))
    keys = missing.groupBy("key").agg(F.count(F.lit(1)).alias("n_refs"))
    return sv.range_hits(keys, removed_ranges(spark, d)).select("key", "n_refs", "chapter")


@query(f"""SELECT a.act_citation, a.title, a.effective_date, s.citation
FROM (SELECT act_citation, min(title) AS title, min(effective_date) AS effective_date FROM public_acts GROUP BY act_citation) a
LEFT JOIN (SELECT DISTINCT x.key, d.citation FROM {_X} x JOIN documents d ON d.doc_id = x.from_id WHERE x.kind = 'publicact') s ON s.key = a.act_citation""")
def public_act_targets(spark, d):
    return sv.public_act(table(spark, d, "public_acts"), refs_once(spark, d).where("kind = 'publicact'"), table(spark, d, "documents"))


# --- changes, merge ----------------------------------------------------------------------------


def change_log(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.satellites import document_history

    h = document_history(table(spark, d, "versions"))
    w = Window.partitionBy("document_id").orderBy("valid_from")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "citation", "removed_at")
    seen = h.withColumn("change_type", F.when(F.row_number().over(w) == 1, "new").otherwise("modified")).select("document_id", "change_type", F.col("valid_from").alias("at"))
    gone = docs.where("removed_at is not null").select("document_id", F.lit("removed").alias("change_type"), F.col("removed_at").alias("at"))
    return seen.unionByName(gone).join(docs.select("document_id", "source", "citation"), "document_id")


_CHANGES = """
o AS (SELECT DISTINCT document_id, first_seen, lower(trim(content_hash)) AS h, trim(regexp_replace(trim(lower(status)), '\\.+$', '')) AS s FROM versions WHERE first_seen IS NOT NULL),
l AS (SELECT *, lag(h) OVER w AS ph, lag(s) OVER w AS ps, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY document_id ORDER BY first_seen)),
c AS (SELECT document_id, CASE WHEN n = 1 THEN 'new' ELSE 'modified' END AS change_type, first_seen AS at FROM l WHERE n = 1 OR h IS DISTINCT FROM ph OR s IS DISTINCT FROM ps
      UNION ALL SELECT doc_id, 'removed', removed_at FROM documents WHERE removed_at IS NOT NULL)"""


@query(f"""WITH {_CHANGES}
SELECT c.document_id, c.change_type, c.at, d.source, d.citation FROM c JOIN documents d ON d.doc_id = c.document_id WHERE substr(c.at, 1, 10) >= '2026-01-01'
ORDER BY c.at DESC, c.document_id, c.change_type LIMIT 500""")
def list_changes(spark, d):
    return sv.list_changes(change_log(spark, d), "2026-01-01", limit=500).select("document_id", "change_type", "at", "source", "citation")


@query(f"""WITH {_CHANGES}
SELECT d.source, c.change_type, substr(c.at, 1, 7) AS month, count(*) AS n FROM c JOIN documents d ON d.doc_id = c.document_id GROUP BY ALL""")
def changes_by_month(spark, d):
    return change_log(spark, d).groupBy("source", "change_type", F.substring("at", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


# A text as the digest sees it: white space of any script to single blanks, then a JSON string.
_SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _digest(*columns: str) -> str:
    told = [f"CAST(to_json(trim(regexp_replace(coalesce({c}, ''), '{_SPACES}', ' ', 'g'))) AS VARCHAR)" for c in columns]
    return "sha256('[' || " + " || ', ' || ".join(told) + " || ']')"


@query(f"SELECT doc_id, {_digest('citation', 'text', 'act_name', 'url', 'kind')} AS content_hash FROM documents")
def content_hash_query(spark, d):
    """The digest of whole texts, with whatever white space, signs and scripts they have."""
    return table(spark, d, "documents").select("doc_id", content_hash(*[F.col(c) for c in ("citation", "text", "act_name", "url", "kind")]).alias("content_hash"))


_SNAP = f"""(SELECT DISTINCT snapshot_no, lower(trim(source)) AS source, {_cite("citation")} AS citation, coalesce(variant, '') AS variant, coalesce(lower(content_hash), '') AS h
FROM corpus_snapshots WHERE is_current)"""


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Current rows of each delivery as records for the merge; the digest stands for the text."""
    s = table(spark, d, "corpus_snapshots").where("is_current").select(
        "snapshot_no", F.lower(F.trim("source")).alias("source"), normalize_citation(F.col("citation")).alias("citation"),
        F.coalesce("variant", F.lit("")).alias("variant"), F.coalesce(F.lower("content_hash"), F.lit("")).alias("text"),
    ).distinct()
    have = s.columns
    rest = [F.lit(None).cast(kind).alias(c) for c, kind in (f.split() for f in mg.DOC_SCHEMA.split(", ")) if c not in have and c != "ordinal"]
    return s.select("*", F.lit(0).cast("bigint").alias("ordinal"), *rest)


def merge_replay(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[dict]]:
    """All deliveries through the merge in turn, each a complete crawl of the sources in it, into an
    empty store: the changes of all runs, the versions at the end, the runs' reports.

    Documents, versions and changes are checkpointed after each run, so no plan holds an earlier
    run's. There are as many runs as deliveries; only their numbers and sources are collected.
    """
    rows = reliable(deliveries(spark, d))
    docs, versions = spark.createDataFrame([], mg.DOCUMENTS), spark.createDataFrame([], mg.VERSIONS)
    runs = rows.groupBy("snapshot_no").agg(F.sort_array(F.collect_set("source")).alias("kinds")).orderBy("snapshot_no").collect()
    changes, reports = spark.createDataFrame([], mg.CHANGES), []
    for r in runs:
        run = mg.Run(r.snapshot_no, str(r.snapshot_no), name="replay", kinds=list(r.kinds))
        m = mg.merge(docs, versions, rows.where(F.col("snapshot_no") == r.snapshot_no).drop("snapshot_no"), run)
        docs, versions = reliable(m.documents), reliable(m.versions)
        changes = changes.unionByName(reliable(m.changes))
        reports.append(m.report)
    return changes, versions, reports


_REPLAY = f"""WITH s AS {_SNAP}, n AS (SELECT source, snapshot_no, row_number() OVER (PARTITION BY source ORDER BY snapshot_no) AS k FROM (SELECT DISTINCT source, snapshot_no FROM s)),
l AS (SELECT s.*, n.k, lag(h) OVER w AS ph, lag(k) OVER w AS pk, lead(k) OVER w AS nk FROM s JOIN n USING (source, snapshot_no) WINDOW w AS (PARTITION BY source, citation, variant ORDER BY k)),
v AS (SELECT *, CAST(sum(CASE WHEN ph IS NULL OR ph <> h THEN 1 ELSE 0 END) OVER (PARTITION BY source, citation, variant ORDER BY k) AS INTEGER) AS version_no FROM l),
c AS (SELECT CAST(snapshot_no AS BIGINT) AS run_id, source, citation, variant, version_no, CASE WHEN pk IS NULL THEN 'new' WHEN pk < k - 1 THEN 'restored' WHEN ph <> h THEN 'modified' END AS change_type FROM v
      UNION ALL SELECT CAST(n.snapshot_no AS BIGINT), v.source, citation, variant, version_no, 'removed' FROM v JOIN n ON n.source = v.source AND n.k = v.k + 1 WHERE nk IS NULL OR nk > v.k + 1)"""


@query(f"{_REPLAY} SELECT * FROM c WHERE change_type IS NOT NULL")
def merge_changes(spark, d):
    """What the merge reports for whole deliveries, removals included."""
    return merge_replay(spark, d)[0].drop("at")


@query(f"""{_REPLAY} SELECT source, citation, variant, version_no, CAST(min(snapshot_no) AS BIGINT) AS run_id, min(h) AS text, CAST(min(snapshot_no) AS VARCHAR) AS first_seen, CAST(max(snapshot_no) AS VARCHAR) AS last_seen,
version_no = max(version_no) OVER (PARTITION BY source, citation, variant) AS is_current FROM v GROUP BY source, citation, variant, version_no""")
def merge_versions(spark, d):
    """All versions the merge holds after the last delivery."""
    return merge_replay(spark, d)[1].select("source", "citation", "variant", "version_no", "run_id", "text", "first_seen", "last_seen", "is_current")


@query(f"""{_REPLAY} SELECT r.run_id, docs_seen, {", ".join(f"coalesce(docs_{k}, 0) AS docs_{k}" for k in ("new", "modified", "removed", "restored"))}
FROM (SELECT CAST(snapshot_no AS BIGINT) AS run_id, count(*) AS docs_seen FROM s GROUP BY 1) r LEFT JOIN
(SELECT run_id, {", ".join(f"count(*) FILTER (WHERE change_type = '{k}') AS docs_{k}" for k in ("new", "modified", "removed", "restored"))} FROM c GROUP BY run_id) USING (run_id)""")
def merge_run_report(spark, d):
    """The merge's counters of each delivery."""
    cols = ["run_id", "docs_seen", "docs_new", "docs_modified", "docs_removed", "docs_restored"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in merge_replay(spark, d)[2]], ", ".join(f"{c} bigint" for c in cols))


def crawled(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a crawl brings them, act names for catchlines, with their numbers."""
    docs = table(spark, d, "documents").select("doc_id", "source", "citation", F.coalesce("variant", F.lit("")).alias("variant"), "kind", "chapter", "act_citation", "act_name", "url", F.col("act_name").alias("catchline"), "text")
    rest = [F.lit(None).cast("string").alias(c) for c in ("history_note", "compilers_notes", "effective_date")]
    return docs.select(F.col("doc_id").alias("ordinal"), "*", F.lit("active").alias("status"), *rest)


ALL_KINDS = ["mcl", "mcr", "mre", "const"]


def _empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], mg.DOCUMENTS), spark.createDataFrame([], mg.VERSIONS)


@query(f"""WITH t AS (SELECT *, source = 'mcl' AND coalesce(TRY_CAST(regexp_extract(chapter, '^[0-9]+') AS INTEGER) % 2 = 0, FALSE) AS scoped FROM documents),
u AS (SELECT *, scoped AND doc_id % 5 = 0 AS gone, scoped AND doc_id % 5 = 1 AS changed, CASE WHEN scoped AND doc_id % 5 = 1 THEN coalesce(text, '') || ' Amended "so".' ELSE text END AS now FROM t)
SELECT citation, coalesce(variant, '') AS variant, NOT gone AS active, CASE WHEN gone THEN '2' END AS removed_at, CASE WHEN changed THEN 2 ELSE 1 END AS n_versions,
CASE WHEN scoped AND NOT gone THEN '2' ELSE '1' END AS last_seen, {_digest("act_name", "now", "''", "''", "'active'")} AS content_hash, CASE WHEN gone THEN 'removed' WHEN changed THEN 'modified' END AS change_type FROM u""")
def merge_scope(spark, d):
    """All documents merged with their whole texts, then a crawl of the even chapters in which a fifth is missing and
    a fifth has another text: nothing outside its scope is touched."""
    docs, versions = _empty(spark)
    rows = crawled(spark, d)
    one = mg.merge(docs, versions, rows.drop("doc_id"), mg.Run(1, "1", "all", ALL_KINDS))
    docs, versions = reliable(one.documents), reliable(one.versions)
    even = F.coalesce(F.regexp_extract("chapter", "^[0-9]+", 0).try_cast("int") % 2 == 0, F.lit(False)) & (F.col("source") == "mcl")
    # There are some hundred chapters, however many documents.
    scope = [r.chapter for r in rows.where(even).select("chapter").distinct().collect()]
    again = rows.where(even & (F.col("doc_id") % 5 != 0)).withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(' Amended "so".'))).otherwise(F.col("text")))
    two = mg.merge(docs, versions, again.drop("doc_id"), mg.Run(2, "2", "mcl", ["mcl"], chapters=scope, guard=0.5))
    v = two.versions.groupBy(*mg.KEY).agg(
        F.count(F.lit(1)).cast("int").alias("n_versions"), F.max(F.when(F.col("is_current"), F.col("last_seen"))).alias("last_seen"), F.max(F.when(F.col("is_current"), F.col("content_hash"))).alias("content_hash")
    )
    return two.documents.join(v, mg.KEY).join(two.changes.select(*mg.KEY, "change_type"), mg.KEY, "left").select(
        "citation", "variant", "active", "removed_at", "n_versions", "last_seen", "content_hash", "change_type"
    )


@query(f"""WITH t AS (SELECT *, source = 'mcl' AND coalesce(TRY_CAST(regexp_extract(chapter, '^[0-9]+') AS INTEGER) % 2 = 0, FALSE) AS scoped, coalesce(variant, '') AS v FROM documents),
u AS (SELECT *, scoped AND doc_id % 5 = 0 AS gone, CASE WHEN scoped AND doc_id % 5 = 1 THEN coalesce(text, '') || ' Amended "so".' ELSE text END AS now FROM t)
SELECT source, citation, v AS variant, CASE WHEN gone THEN 'removed' WHEN scoped AND doc_id % 5 = 1 THEN 'modified' END AS second_run,
CASE WHEN v = '' AND NOT gone THEN CAST(len({_tokens_sql("citation")}) + len({_tokens_sql("act_name")}) + len({_tokens_sql("now")}) AS BIGINT) END AS indexed_tokens,
CASE WHEN v = '' THEN (SELECT count(DISTINCT r) FROM (SELECT unnest(regexp_extract_all(now, '\\bMRE\\s+[0-9]{{3,4}}')) AS r) WHERE regexp_replace(r, '\\s+', ' ') <> citation) ELSE 0 END AS rule_references FROM u""")
def store_runs(spark, d):
    """Two runs of the store, all documents and then a crawl of the even chapters: what its change log, its search
    index and its references say of every document."""
    from ..sources.loaders import Crawl
    from ..store import Store

    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/stores/{uuid.uuid4().hex}")
    rows = crawled(spark, d)
    store.ingest(Crawl("all", rows.drop("doc_id"), kinds=ALL_KINDS), now="2026-01-01T00:00:00Z")
    even = F.coalesce(F.regexp_extract("chapter", "^[0-9]+", 0).try_cast("int") % 2 == 0, F.lit(False)) & (F.col("source") == "mcl")
    scope = [r.chapter for r in rows.where(even).select("chapter").distinct().collect()]
    again = rows.where(even & (F.col("doc_id") % 5 != 0)).withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(' Amended "so".'))).otherwise(F.col("text")))
    store.ingest(Crawl("mcl", again.drop("doc_id"), kinds=["mcl"], chapters=scope), guard=0.5, now="2026-01-02T00:00:00Z")
    key = ["source", "citation"]
    changes = store.table("changes").where("run_id = 2").select(*mg.KEY, F.col("change_type").alias("second_run"))
    stats = store.table("doc_stats").select(*key, F.lit("").alias("variant"), F.col("tokens").alias("indexed_tokens"))
    refs = store.table("xrefs").where("kind = 'mre'").groupBy(*key).agg(F.countDistinct("raw").alias("n")).select(*key, F.lit("").alias("variant"), "n")
    docs = store.table("documents").select(*mg.KEY)
    return docs.join(changes, mg.KEY, "left").join(stats, mg.KEY, "left").join(refs, mg.KEY, "left").select(
        *mg.KEY, "second_run", "indexed_tokens", F.coalesce("n", F.lit(0)).alias("rule_references")
    )


@query("""WITH k AS (SELECT unnest([7, 8, 9, 10]) AS k), n AS (SELECT CAST(count(*) AS BIGINT) AS held FROM documents),
s AS (SELECT k, CAST(count(*) FILTER (WHERE doc_id % 10 < k) AS BIGINT) AS seen FROM documents, k GROUP BY k)
SELECT k, seen, held, seen < 0.85 * held AS refused, CASE WHEN seen < 0.85 * held THEN 0 ELSE held - seen END AS docs_removed FROM s, n""")
def merge_guard(spark, d):
    """Complete crawls that see 7, 8, 9 or all of ten documents, against a guard of 85 per cent."""
    docs, versions = _empty(spark)
    rows = reliable(crawled(spark, d).withColumn("text", F.lit("")))
    one = mg.merge(docs, versions, rows.drop("doc_id"), mg.Run(1, "1", "all", ALL_KINDS))
    docs, versions = reliable(one.documents), reliable(one.versions)
    out, held = [], docs.count()
    for k in (7, 8, 9, 10):
        part = rows.where(F.col("doc_id") % 10 < k)
        try:
            m = mg.merge(docs, versions, part.drop("doc_id"), mg.Run(2, "2", "all", ALL_KINDS, guard=0.85))
            out.append((k, m.report["docs_seen"], held, False, m.report["docs_removed"]))
        except mg.GuardError:
            out.append((k, part.count(), held, True, 0))
    return spark.createDataFrame(out, "k int, seen bigint, held bigint, refused boolean, docs_removed bigint")


@query("""SELECT citation, coalesce(variant, '') AS variant, CAST(n AS INTEGER) AS version_no, CASE WHEN n = 1 THEN 'new' ELSE 'modified' END AS change_type,
n = CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS is_current FROM (SELECT *, unnest(range(1, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END)) AS n FROM documents)""")
def merge_duplicate_keys(spark, d):
    """Each key three times in one run, in order: first text, another, then (even documents) the first again."""
    docs, versions = _empty(spark)
    rows = crawled(spark, d).withColumn("n", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    other = (F.col("n") == 2) | ((F.col("n") == 3) & (F.col("doc_id") % 2 == 1))
    rows = rows.withColumns({"text": F.when(other, "another").otherwise(F.concat_ws(" ", "text", F.lit("first"))), "ordinal": F.struct("doc_id", "n")})
    m = mg.merge(docs, versions, rows.drop("doc_id", "n"), mg.Run(1, "1", "all", ALL_KINDS))
    return m.changes.join(m.versions.select(*mg.KEY, "version_no", "is_current"), [*mg.KEY, "version_no"]).select("citation", "variant", "version_no", "change_type", "is_current")


# --- history, feed, manifest, bills ----------------------------------------------------------------


_ENTRY = r"(?i)^((am|add|rep|comp|sub)\.? )?[0-9]{4}, ?act [0-9]+(, ?(imd\. ?)?eff\. ?.+)?$"


@query(rf"""
WITH r AS (SELECT DISTINCT entry_id, trim(regexp_replace(raw, '[\s\x{{A0}}]+', ' ', 'g')) AS x FROM history_entries WHERE raw IS NOT NULL),
m AS (SELECT *, regexp_matches(x, '{_ENTRY}') AS fits, lower(regexp_extract(x, '(?i)^(am|add|rep|comp|sub)\.? ', 1)) AS op, regexp_extract(x, '(?i)eff\. ?(.+)$', 1) AS eff FROM r WHERE x <> '')
SELECT entry_id, CASE WHEN NOT fits THEN 'other' ELSE CASE op WHEN '' THEN 'enacted' WHEN 'am' THEN 'amended' WHEN 'add' THEN 'added' WHEN 'rep' THEN 'repealed' WHEN 'comp' THEN 'compiled' ELSE 'substituted' END END AS kind,
  CASE WHEN fits THEN regexp_extract(x, '([0-9]{{4}}),', 1) || ' PA ' || CAST(CAST(regexp_extract(x, '(?i)act ([0-9]+)', 1) AS INTEGER) AS VARCHAR) END AS act_citation,
  fits AND regexp_matches(x, '(?i), ?imd\. ?eff\.') AS immediate_effect, CASE WHEN fits THEN nullif(trim(eff), '') END AS effective_raw
FROM m""")
def history_parse(spark, d):
    """Every entry's raw text parsed by itself."""
    h = table(spark, d, "history_entries").where("raw is not null").select("entry_id", "raw").distinct()
    e = h.select("entry_id", F.get(parse_history(F.col("raw")), 0).alias("e")).where("e is not null").select("entry_id", "e.*")
    return e.select("entry_id", "kind", "act_citation", "immediate_effect", "effective_raw")


@query(rf"""
WITH r AS (SELECT DISTINCT entry_id, document_id, trim(regexp_replace(raw, '[\s\x{{A0}}]+', ' ', 'g')) AS x FROM history_entries WHERE raw IS NOT NULL AND document_id IS NOT NULL AND NOT contains(raw, ';')),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY entry_id, x) AS INTEGER) AS seq FROM r WHERE x <> ''),
m AS (SELECT *, regexp_matches(x, '{_ENTRY}') AS fits, lower(regexp_extract(x, '(?i)^(am|add|rep|comp|sub)\.? ', 1)) AS op, nullif(trim(regexp_extract(x, '(?i)eff\. ?(.+)$', 1)), '') AS eff FROM n)
SELECT document_id, seq, x AS raw, CASE WHEN NOT fits THEN 'other' ELSE CASE op WHEN '' THEN CASE WHEN seq = 1 THEN 'enacted' ELSE 'other' END WHEN 'am' THEN 'amended' WHEN 'add' THEN 'added' WHEN 'rep' THEN 'repealed' WHEN 'comp' THEN 'compiled' ELSE 'substituted' END END AS kind,
  CASE WHEN fits THEN regexp_extract(x, '([0-9]{{4}}),', 1) || ' PA ' || CAST(CAST(regexp_extract(x, '(?i)act ([0-9]+)', 1) AS INTEGER) AS VARCHAR) END AS act_citation,
  CASE WHEN fits AND regexp_matches(eff, '^[A-Za-z]{{3,}}\.? [0-9]{{1,2}}, ?[0-9]{{4}}\.?$') THEN strftime(TRY_CAST(regexp_extract(eff, '([0-9]{{4}})\.?$', 1) || '-' ||
    CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(eff, 1, 3))) + 2) // 3 AS VARCHAR) || '-' || regexp_extract(eff, ' ([0-9]{{1,2}}),', 1) AS DATE), '%Y-%m-%d') END AS effective_date
FROM m""")
def history_documents(spark, d):
    """The entries of a document written as one history string and taken apart: order, the first as enacted, dates."""
    h = table(spark, d, "history_entries").where("raw is not null and document_id is not null and not contains(raw, ';')").select("entry_id", "document_id", "raw").distinct()
    x = h.withColumn("x", F.trim(F.regexp_replace("raw", r"[\s\x{A0}]+", " "))).where("x <> ''")
    whole = x.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_id", "x"))), lambda e: e["x"]), " ;-- ").alias("h"))
    return whole.select("document_id", F.inline(parse_history(F.col("h")))).select("document_id", "seq", "raw", "kind", "act_citation", "effective_date")


@query("SELECT DISTINCT event_id, kind, citation, act_citation, nullif(variant, '') AS variant FROM feed_events")
def feed_classify(spark, d):
    """Events classified from title and object; the table states the answer beside it."""
    f = table(spark, d, "feed_events").select("event_id", "raw_title", "object_name").distinct()
    return f.select("event_id", fd.classify(F.col("raw_title"), F.col("object_name")).alias("e")).select("event_id", "e.*")


_NODES = """(SELECT DISTINCT event_id, substr(citation, 5) || coalesce(CASE WHEN variant LIKE '[%' THEN variant WHEN variant <> '' THEN '.' || variant END, '') AS node,
  citation, CAST(NULL AS VARCHAR) AS act, nullif(variant, '') AS variant, '' AS what FROM feed_events WHERE citation IS NOT NULL
  UNION ALL SELECT DISTINCT event_id, 'Act.' || split_part(act_citation, ' ', 3) || '.of.' || substr(act_citation, 1, 4), NULL, act_citation, NULL, 'act_' FROM feed_events WHERE starts_with(kind, 'act_')
  UNION ALL SELECT DISTINCT event_id, split_part(act_citation, ' ', 3) || '.' || substr(act_citation, 1, 4) || '.5.II-A', NULL, act_citation, NULL, 'heading_' FROM feed_events WHERE starts_with(kind, 'heading_') AND act_citation IS NOT NULL)"""


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'unrecognized' ELSE what || (CASE event_id % 2 WHEN 0 THEN 'deleted' ELSE 'moved_to_code' END) END AS kind,
CASE WHEN event_id % 3 <> 2 THEN citation END AS citation, CASE WHEN event_id % 3 <> 2 THEN act END AS act_citation, CASE WHEN event_id % 3 <> 2 THEN variant END AS variant FROM {_NODES}""")
def feed_titles(spark, d):
    """Titles of every form, written from the fields of events and read back: sections with variants, acts and
    heading nodes, told with a dash, with "has been", or (a third) in a form nobody knows."""
    f = table(spark, d, "feed_events").select("event_id", "citation", "act_citation", "variant", F.col("kind").alias("was")).distinct()
    year, number, has = F.substring("act_citation", 1, 4), F.substring_index("act_citation", " ", -1), F.coalesce(F.col("variant"), F.lit("")) != ""
    node = (
        F.when(F.col("citation").isNotNull(), F.concat(F.substring("citation", 5, 99), F.when(~has, "").when(F.col("variant").startswith("["), F.col("variant")).otherwise(F.concat(F.lit("."), "variant"))))
        .when(F.col("was").startswith("act_"), F.concat(F.lit("Act."), number, F.lit(".of."), year))
        .when(F.col("was").startswith("heading_"), F.concat(number, F.lit("."), year, F.lit(".5.II-A")))
    )
    verb = F.when(F.col("event_id") % 2 == 0, "deleted").otherwise("Moved  to code")
    link = F.element_at(F.array(F.lit(" - "), F.lit(" has  been "), F.lit(" ought to be ")), (F.col("event_id") % 3 + 1).cast("int"))
    told = f.where(node.isNotNull()).select("event_id", F.concat(F.lit("Section "), node, link, verb).alias("title"))
    return told.select("event_id", fd.classify(F.col("title"), F.lit(None).cast("string")).alias("e")).select("event_id", "e.*")


_SEEN = "(SELECT DISTINCT event_id, raw_title, object_name, kind, citation, act_citation, nullif(variant, '') AS variant FROM feed_events)"


@query(f"""SELECT DISTINCT list, value FROM (
SELECT 'variant_nodes' AS list, citation || ' ' || variant AS value FROM {_SEEN} WHERE variant IS NOT NULL UNION ALL SELECT 'act_level_events', act_citation FROM {_SEEN} WHERE starts_with(kind, 'act_') AND act_citation IS NOT NULL
UNION ALL SELECT 'acts_touched', act_citation FROM {_SEEN} WHERE act_citation IS NOT NULL UNION ALL SELECT 'unrecognized_titles', raw_title FROM {_SEEN} WHERE kind = 'unrecognized'
UNION ALL SELECT 'refetch_sections', citation FROM {_SEEN} WHERE citation IS NOT NULL UNION ALL SELECT 'refetch_objects', object_name FROM {_SEEN} WHERE citation IS NOT NULL AND object_name IS NOT NULL
UNION ALL SELECT 'recrawl_acts', act_citation FROM {_SEEN} WHERE act_citation IS NOT NULL UNION ALL SELECT 'unrecognized', raw_title FROM {_SEEN} WHERE kind = 'unrecognized')""")
def feed_lists(spark, d):
    """The lists of a feed's summary and the work its new events make."""
    f = table(spark, d, "feed_events").select("event_id", "raw_title", "object_name").distinct()
    e = f.select("*", fd.classify(F.col("raw_title"), F.col("object_name")).alias("e")).select("raw_title", "object_name", "e.*")
    return fd.summary_lists(e).unionByName(fd.work_lists(e))


@query("SELECT count(DISTINCT (coalesce(feed_built_at, ''), coalesce(raw_title, ''), coalesce(object_name, ''))) AS n_logged, CAST(count(*) AS BIGINT) AS n_delivered FROM feed_events")
def feed_dedupe(spark, d):
    f = table(spark, d, "feed_events")
    return fd.record(f.limit(0), f).agg(F.count(F.lit(1)).alias("n_logged")).join(f.agg(F.count(F.lit(1)).alias("n_delivered")), F.lit(True))


_EVENTS = "(SELECT DISTINCT event_id, kind, citation, act_citation FROM feed_events)"


def events_once(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed_events").select("event_id", "raw_title", "object_name").distinct()
    return f.select("event_id", fd.classify(F.col("raw_title"), F.col("object_name")).alias("e")).select("event_id", "e.*")


@query(f"SELECT kind, count(*) AS n_events FROM {_EVENTS} GROUP BY kind")
def feed_summary_kind(spark, d):
    return fd.summary_by_kind(events_once(spark, d))


@query(f"SELECT regexp_extract(citation, '^MCL ([0-9]+[A-Z]?)\\.', 1) AS chapter, count(*) AS n_events FROM {_EVENTS} WHERE citation IS NOT NULL GROUP BY 1")
def feed_summary_chapter(spark, d):
    return fd.summary_by_chapter(events_once(spark, d))


@query(f"""
WITH e AS {_EVENTS}, k AS (SELECT DISTINCT act_citation, chapter FROM documents WHERE chapter IS NOT NULL),
a AS (SELECT DISTINCT act_citation FROM e WHERE citation IS NULL AND act_citation IS NOT NULL)
SELECT DISTINCT regexp_extract(citation, '^MCL ([0-9]+[A-Z]?)\\.', 1) AS chapter, CAST(NULL AS VARCHAR) AS act_citation, TRUE AS mapped FROM e WHERE citation IS NOT NULL
UNION ALL SELECT k.chapter, a.act_citation, k.chapter IS NOT NULL FROM a LEFT JOIN k USING (act_citation)""")
def feed_resolve_chapters(spark, d):
    return fd.resolve_chapters(events_once(spark, d), table(spark, d, "documents"))


_LIST = """(SELECT source, name, run_id, max(size) AS size, max(modified) AS modified, max(lower(sha256)) AS sha256,
row_number() OVER (PARTITION BY source, name ORDER BY run_id DESC) AS k FROM source_files GROUP BY source, name, run_id)"""


@query(f"""SELECT coalesce(a.source, b.source) AS source, coalesce(a.name, b.name) AS name,
CASE WHEN a.name IS NULL THEN 'vanished' WHEN b.name IS NULL OR a.size IS DISTINCT FROM b.size OR a.modified IS DISTINCT FROM b.modified OR b.sha256 IS NULL THEN 'fetch' ELSE 'unchanged' END AS action
FROM (SELECT * FROM {_LIST} WHERE k = 1) a FULL JOIN (SELECT * FROM {_LIST} WHERE k = 2) b ON a.source = b.source AND a.name = b.name""")
def manifest_plan(spark, d):
    """The newest listing of each file against the one before."""
    per = table(spark, d, "source_files").groupBy("source", "name", "run_id").agg(F.max("size").alias("size"), F.max("modified").alias("modified"), F.max(F.lower("sha256")).alias("sha256"))
    k = per.withColumn("k", F.row_number().over(Window.partitionBy("source", "name").orderBy(F.desc("run_id"))))
    return mf.plan_fetch(k.where("k = 2"), k.where("k = 1"), ["source", "name"])


@query(f"""SELECT l_orderkey, CASE WHEN a <> b THEN own WHEN first < own THEN first || ',' || own ELSE own || ',' || first END AS sections,
CASE WHEN a = b THEN '' ELSE first || '..MCL ' || (b % 700 + 1) || '.' || b END AS spans, '1931 PA ' || (1 + l_orderkey % 400) AS acts, l_orderkey % 3 = 0 AS creates_new_act
FROM (SELECT *, 'MCL ' || (a % 700 + 1) || '.' || a AS first, 'MCL ' || (800 + l_orderkey % 99) || '.' || (l_orderkey % 99999 + 1) AS own FROM ({_SECTIONS}))""")
def bill_spans(spark, d):
    """Descriptions rendered from order numbers, their targets read back."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_suppkey").alias("b"))
    o = F.col("l_orderkey")
    own = F.concat((o % 99 + 800).cast("string"), F.lit("."), (o % 99999 + 1).cast("string"))
    desc = F.concat(
        F.when(o % 3 == 0, "Fees; creates new act. ").otherwise("Fees; amends. "), F.lit("Amends MCL "), _part_cite(F.col("a")), F.lit(" - "), _part_cite(F.col("b")),
        F.lit(" and MCL "), own, F.lit(" of 1931 PA "), (o % 400 + 1).cast("string"), F.lit("."),
    )
    t = with_targets(x.withColumn("description", desc))
    return t.select("l_orderkey", F.array_join("sections", ",").alias("sections"), F.array_join(F.transform("spans", lambda s: F.concat_ws("..", s["start"], s["end"])), ",").alias("spans"),
                    F.array_join("acts", ",").alias("acts"), "creates_new_act")


# --- search -----------------------------------------------------------------------------------------

_FIELDS = {"citation": "citation", "catchline": "act_name", "text": "text"}


def searchable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "citation", F.col("act_name").alias("catchline"), "text", "source", "chapter", "active", "variant", "url", F.lit("active").alias("status"))


_HELD = "(SELECT * FROM documents WHERE active AND coalesce(variant, '') = '')"


def held_docs(spark: SparkSession, d: str) -> DataFrame:
    """What the index holds: active documents in their ordinary form."""
    return searchable(spark, d).where(F.col("active") & (F.coalesce("variant", F.lit("")) == ""))


@query(f"""SELECT term, count(DISTINCT doc_id) AS n_documents, CAST(count(*) AS BIGINT) AS n_occurrences FROM (
{" UNION ALL ".join(f"SELECT doc_id, unnest({_TOK.format(c=c)}) AS term FROM {_HELD}" for c in _FIELDS.values())}) GROUP BY term""")
def index_postings(spark, d):
    p = se.postings(held_docs(spark, d), "doc_id", list(_FIELDS), stem=False)
    return p.groupBy("term").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum(F.size("positions")).cast("bigint").alias("n_occurrences"))


@query(f"SELECT doc_id, CAST({' + '.join(f'len({_TOK.format(c=c)})' for c in _FIELDS.values())} AS BIGINT) AS tokens FROM {_HELD}")
def index_doc_stats(spark, d):
    return se.doc_stats(held_docs(spark, d), "doc_id", list(_FIELDS))


def _bm25_sql(term: str) -> str:
    counts = ", ".join(f"len(list_filter({_TOK.format(c=c)}, lambda x: x = '{term}')) AS c_{f}" for f, c in _FIELDS.items())
    n = " + ".join(f"len({_TOK.format(c=c)})" for c in _FIELDS.values())
    return f"""
WITH t AS (SELECT doc_id, {counts}, {n} AS n FROM {_HELD}),
f AS (SELECT doc_id, n, 10.0 * c_citation + 5.0 * c_catchline + 1.0 * c_text AS f FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS df FROM f),
i AS (SELECT *, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END AS idf FROM s)
SELECT doc_id, round(CAST(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) AS DOUBLE), 6) AS score FROM f JOIN i ON TRUE WHERE f > 0"""


_STORED: dict[tuple[str, str, bool], tuple[DataFrame, DataFrame]] = {}


def stored_index(spark: SparkSession, d: str, stem: bool) -> tuple[DataFrame, DataFrame]:
    """Postings sorted by term and token counts of the documents in ``d``, written once per session, as
    the store keeps them per commit: a search reads the row groups of its terms only."""
    at = (spark.sparkContext.applicationId, d, stem)
    if at not in _STORED:
        docs = held_docs(spark, d)
        p = se.postings(docs, "doc_id", list(_FIELDS), stem)
        ordered = p.repartitionByRange("term").sortWithinPartitions("term", "doc_id")
        _STORED[at] = materialize(ordered, "postings"), materialize(se.doc_stats(docs, "doc_id", list(_FIELDS)), "doc_stats")
    return _STORED[at]


def _run(spark: SparkSession, d: str, text: str) -> DataFrame:
    q = se.parse_query(text, stem=False)
    index, stats = stored_index(spark, d, stem=False)
    return se.bm25(se.match(index, "doc_id", q), stats, "doc_id", q)


@query(_bm25_sql("tribunal"))
def search_term_bm25(spark, d):
    return _run(spark, d, "tribunal").select("doc_id", F.round("score", 6).alias("score"))


_BAG = " || ' ' || ".join(f"' ' || array_to_string({_TOK.format(c=c)}, ' ') || ' | '" for c in _FIELDS.values())


@query(f"""SELECT doc_id FROM (SELECT doc_id, {_BAG} AS b FROM {_HELD})
WHERE (contains(b, ' sludge ') AND NOT contains(b, ' ferry ')) OR (contains(b, ' harbor ') AND contains(b, ' museum '))""")
def search_boolean(spark, d):
    return _run(spark, d, "sludge NOT ferry OR harbor AND museum").select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_BAG} AS b FROM {_HELD}) WHERE contains(b, ' effective date ') AND contains(b, ' shall ')")
def search_phrase(spark, d):
    return _run(spark, d, '"effective date" shall').select("doc_id")


@query(f"""WITH m AS ({_bm25_sql("tribunal").replace("round(CAST(", "CAST(").replace("DOUBLE), 6)", "DOUBLE)")})
SELECT doc_id, citation, source, chapter, round(score, 6) AS score FROM m JOIN documents USING (doc_id) WHERE source = 'mcr' ORDER BY m.score, doc_id LIMIT 50""")
def search_prefilter(spark, d):
    """The ranked search among the court rules only."""
    index, stats = stored_index(spark, d, stem=False)
    return se.search(searchable(spark, d), "tribunal", source="MCR", limit=50, stem=False, index=index, stats=stats).select("doc_id", "citation", "source", "chapter", F.round("score", 6).alias("score"))


# Words of the tables' language with the stems that the query below asks for.
_EFFECT, _DATE, _TRIBUN = "effect(s|ed|ing|ive|ively|iveness)?", "dat(e|es|ed|ing)", "tribun(al|als|e|es)"


def _pairs(tokens: str) -> str:
    return f"len(list_filter(range(1, len({tokens})), lambda i: regexp_full_match({tokens}[i], '{_EFFECT}') AND regexp_full_match({tokens}[i + 1], '{_DATE}')))"


_STEMMED = f"""
WITH t AS (SELECT doc_id, citation, text, {", ".join(f"{_TOK.format(c=c)} AS k_{f}" for f, c in _FIELDS.items())} FROM {_HELD}),
f AS (SELECT doc_id, citation, text, len(k_citation) + len(k_catchline) + len(k_text) AS n, 10.0 * {_pairs("k_citation")} + 5.0 * {_pairs("k_catchline")} + 1.0 * {_pairs("k_text")} AS f,
      len(list_filter(list_concat(k_citation, k_catchline, k_text), lambda x: regexp_full_match(x, '{_TRIBUN}'))) > 0 AS barred FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS df FROM f),
i AS (SELECT *, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END AS idf FROM s),
r AS (SELECT doc_id, citation, text, CAST(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) AS DOUBLE) AS score FROM f JOIN i ON TRUE WHERE f > 0 AND NOT barred),
p AS (SELECT * FROM r ORDER BY score, doc_id LIMIT 20),
w AS (SELECT *, string_split(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B]+', ' ', 'g')), ' ') AS ws FROM p),
m AS (SELECT *, list_transform(ws, lambda x: CASE WHEN len(list_filter({_TOK.format(c="x")}, lambda y: regexp_full_match(y, '{_EFFECT}|{_DATE}|{_TRIBUN}'))) > 0 THEN 1 ELSE 0 END) AS k FROM w),
h AS (SELECT *, list_sum(k[i + 1:i + 24]) AS hits FROM (SELECT *, unnest(range(0, len(ws))) AS i FROM m) WHERE i = 0 OR k[i + 1] = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS place FROM h)
SELECT doc_id, citation, round(score, 6) AS score, CASE WHEN i > 0 THEN '… ' ELSE '' END ||
  array_to_string(list_transform(range(i + 1, least(i + 24, len(ws)) + 1), lambda j: CASE WHEN k[j] = 1 THEN '[' || ws[j] || ']' ELSE ws[j] END), ' ') || CASE WHEN i + 24 < len(ws) THEN ' …' ELSE '' END AS snippet
FROM b WHERE place = 1"""


@query(_STEMMED)
def search_stemmed(spark, d):
    """The ranked search with stems and snippets as a user calls it."""
    index, stats = stored_index(spark, d, stem=True)
    return se.search(searchable(spark, d), '"effective dates" NOT tribunals', limit=20, index=index, stats=stats).select("doc_id", "citation", "snippet", F.round("score", 6).alias("score"))


# --- names of the site -------------------------------------------------------------------------------------


@query("SELECT DISTINCT object_name, citation, nullif(variant, '') AS variant, CASE WHEN citation IS NULL THEN act_citation END AS act_citation FROM feed_events WHERE object_name LIKE 'mcl-act-%' OR (citation IS NOT NULL AND variant IS NULL)")
def object_names(spark, d):
    """Sections and acts read back from the site's names for them."""
    from ..functions.citations import act_of_object, section_of_object

    f = table(spark, d, "feed_events").where(F.col("object_name").startswith("mcl-act-") | (F.col("citation").isNotNull() & F.col("variant").isNull()))
    s = section_of_object(F.col("object_name"))
    return f.select("object_name", s["citation"].alias("citation"), s["variant"].alias("variant"), act_of_object(F.col("object_name")).alias("act_citation")).distinct()


# --- generic table shapes ------------------------------------------------------------------------------


@query("""SELECT c_custkey, o_orderkey, o_orderdate, superseded FROM (SELECT c_custkey, o.o_orderkey, o.o_orderdate, o.newest AS superseded,
row_number() OVER (PARTITION BY c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn FROM customer JOIN
(SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NOT NULL AS newest FROM orders) o ON o.o_custkey = c_custkey WHERE o.o_orderdate < TIMESTAMP '1996-07-01') WHERE rn = 1""")
def as_of_orders(spark, d):
    """The as-of operator on orders as versions of customers."""
    o = table(spark, d, "orders").withColumn("first_seen", F.date_format("o_orderdate", "yyyy-MM-dd"))
    last = sv.as_of(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], sv.check_date("1996-06-30"))
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_orderdate", "superseded")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, ts FROM events) GROUP BY 1, 2")
def stream_feed_counts(spark, d):
    """Events read as a stream, deduplicated on their key, counted per day."""
    from ..streaming.feed_stream import stream_counts

    return stream_counts(spark, f"{d}/events.parquet")


# Names of the functions above that would hide operators of the same name.
for _old, _new in (("narrative_ranges_query", "narrative_ranges"), ("content_hash_query", "content_hash")):
    QUERIES[_new], ORACLES[_new] = QUERIES.pop(_old), ORACLES.pop(_old)

__all__ = ["ORACLES", "QUERIES", "chain_tokens", "references_in"]
