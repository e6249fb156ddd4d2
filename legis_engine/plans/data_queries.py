"""Driver queries of the general data problems, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ledger import ledger, listings_of, run_outcomes, taken_in
from ..operators.orphans import orphan_references, orphan_state
from ..operators.satellites import document_history
from ..operators.snapshots import corpus_changes
from ..operators.timestamps import normalise_times


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_times({n: table(spark, d, n) for n in ("source_files", "feed_events", "history_entries")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return corpus_changes(table(spark, d, "corpus_snapshots"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return taken_in(table(spark, d, "source_files"), table(spark, d, "runs"))


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every item as the ledger holds it after the last run."""
    items = ledger(listings_of(table(spark, d, "source_files")), run_outcomes(table(spark, d, "runs")))
    return items.select("source", "name", "item.state", "item.token", "item.attempts")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "xrefs"), table(spark, d, "documents"), table(spark, d, "public_acts"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_state(table(spark, d, "xrefs"), table(spark, d, "documents"), table(spark, d, "public_acts")).snapshot_counts()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return document_history(table(spark, d, "versions"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_ledger": p3_ledger, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found,
}

# Canonical citation in the oracle's own words: strip everything that cannot matter, then rebuild.
_CITE = r"""
CASE
  WHEN regexp_matches({c}, '^(MCL)?0*[1-9][0-9]*[A-Z]?\.[0-9]+[A-Z]*$')
    THEN 'MCL ' || regexp_extract({c}, '([0-9]+[A-Z]?)\.', 1) || '.' || lower(regexp_extract({c}, '\.([0-9]+[A-Z]*)$', 1))
  WHEN regexp_matches({c}, '^MCR[0-9]+\.[0-9]+[A-Z]?$') THEN 'MCR ' || substr({c}, 4)
  WHEN regexp_matches({c}, '^MRE[0-9]+$') THEN 'MRE ' || substr({c}, 4)
  WHEN regexp_matches({c}, '^(CONST\.?1963|1963CONST\.?),?SCHEDULE,?§[0-9]+[A-Z]?$') THEN 'Const 1963, Schedule, § ' || lower(regexp_extract({c}, '§(.*)$', 1))
  WHEN regexp_matches({c}, '^(CONST\.?1963|1963CONST\.?),?ART(ICLE)?\.?([0-9]+|[IVX]+),?§[0-9]+[A-Z]?$')
    THEN 'Const 1963, art ' || coalesce(CAST(list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'],
           regexp_extract({c}, 'ART(?:ICLE)?\.?([0-9]+|[IVX]+)', 1)) AS VARCHAR), regexp_extract({c}, 'ART(?:ICLE)?\.?([0-9]+)', 1)) || ', § ' || lower(regexp_extract({c}, '§(.*)$', 1))
  WHEN regexp_matches({c}, '^[0-9]{{4}}PA[0-9]+$') THEN substr({c}, 1, 4) || ' PA ' || substr({c}, 7)
  WHEN regexp_matches({c}, '^(PUBLIC)?ACT(NO\.)?[0-9]+OF(THEPUBLICACTSOF)?[0-9]{{4}}$')
    THEN right({c}, 4) || ' PA ' || regexp_extract({c}, 'ACT(?:NO\.)?([0-9]+)OF', 1)
  ELSE {c}
END"""


def _cite(column: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace(upper({column}), '\(.*\)', ''), 'ET SEQ\.?', ''), '[\s\x{{A0}}\x{{2009}}\x{{202F}}]+', '', 'g')"
    return _CITE.format(c=f"({bare})")


_P2 = rf"""
WITH r AS (
  SELECT DISTINCT snapshot_no, lower(trim(source)) AS source, {_cite("citation")} AS citation, coalesce(variant, '') AS variant,
         coalesce(lower(content_hash), '(null)') AS h, is_current
  FROM corpus_snapshots),
n AS (SELECT source, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source ORDER BY snapshot_no) AS prev
      FROM (SELECT DISTINCT source, snapshot_no FROM r)),
c AS (SELECT DISTINCT snapshot_no, source, citation, variant, h FROM r WHERE is_current),
a AS (SELECT c.*, n.prev FROM c JOIN n USING (source, snapshot_no) WHERE n.prev IS NOT NULL),
b AS (SELECT n.snapshot_no, c.source, c.citation, c.variant, c.h FROM c JOIN n ON n.source = c.source AND n.prev = c.snapshot_no)
SELECT CAST(coalesce(a.snapshot_no, b.snapshot_no) AS BIGINT) AS snapshot_no, coalesce(a.source, b.source) AS source,
       coalesce(a.citation, b.citation) AS citation, coalesce(a.variant, b.variant) AS variant,
       CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM a FULL JOIN b ON a.snapshot_no = b.snapshot_no AND a.source = b.source AND a.citation = b.citation AND a.variant = b.variant
WHERE a.h IS DISTINCT FROM b.h"""

_REFS = rf"""
p AS (
  SELECT 'documents' AS to_table, source AS kind, citation AS key, min(first_seen) AS born,
         CASE WHEN count(*) = count(removed_at) THEN max(removed_at) END AS died
  FROM documents WHERE coalesce(variant, '') = '' GROUP BY source, citation
  UNION ALL
  SELECT 'public_acts', 'publicact', act_citation, min(recorded_at), NULL FROM public_acts GROUP BY act_citation),
x AS (
  SELECT DISTINCT xref_id, regexp_replace(lower(to_kind), '[^a-z]', '', 'g') AS kind, {_cite("to_key")} AS key,
         strftime(found_at, '%Y-%m-%dT%H:%M:%SZ') AS found, strftime(found_at, '%Y-%m') AS period
  FROM xrefs WHERE to_key IS NOT NULL),
j AS (
  SELECT x.*, CASE WHEN x.kind = 'publicact' THEN 'public_acts' ELSE 'documents' END AS to_table, p.key AS parent, p.born, p.died
  FROM x LEFT JOIN p ON x.kind = p.kind AND x.key = p.key)"""

_P4 = f"""
WITH {_REFS}
SELECT xref_id, to_table, period,
       CASE WHEN parent IS NULL THEN 'missing' WHEN born > found THEN 'later' ELSE 'deleted' END AS reason
FROM j WHERE parent IS NULL OR born > found OR died <= found"""

_P4_COUNTS = f"""
WITH {_REFS},
s AS (
  SELECT to_table, 'missing' AS reason, substr(found, 1, 7) AS period, 1 AS d FROM j WHERE parent IS NULL
  UNION ALL SELECT to_table, 'later', substr(found, 1, 7), 1 FROM j WHERE born > found
  UNION ALL SELECT to_table, 'later', substr(born, 1, 7), -1 FROM j WHERE born > found
  UNION ALL SELECT to_table, 'deleted', substr(greatest(found, died), 1, 7), 1 FROM j WHERE died IS NOT NULL),
g AS (SELECT strftime(m, '%Y-%m') AS period, to_table, reason FROM (SELECT DISTINCT to_table, reason FROM s),
      (SELECT unnest(generate_series(CAST(min(period) || '-01' AS TIMESTAMP), CAST(max(period) || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM s)),
m AS (SELECT to_table, reason, period, sum(d) AS d FROM s GROUP BY to_table, reason, period)
SELECT period, to_table, reason, CAST(coalesce(sum(d) OVER (PARTITION BY to_table, reason ORDER BY period), 0) AS BIGINT) AS open_orphans FROM g LEFT JOIN m USING (to_table, reason, period)"""

_P5 = """
WITH o AS (
  SELECT DISTINCT document_id, first_seen, lower(trim(content_hash)) AS h, trim(regexp_replace(trim(lower(status)), '\\.+$', '')) AS status
  FROM versions WHERE first_seen IS NOT NULL),
l AS (
  SELECT *, lag(h) OVER w AS ph, lag(status) OVER w AS ps, row_number() OVER w AS n FROM o
  WINDOW w AS (PARTITION BY document_id ORDER BY first_seen)),
v AS (SELECT * FROM l WHERE n = 1 OR h IS DISTINCT FROM ph OR status IS DISTINCT FROM ps)
SELECT document_id, first_seen AS valid_from, coalesce(lead(first_seen) OVER (PARTITION BY document_id ORDER BY first_seen), '') AS valid_to, status
FROM v"""

# Dates and times in the oracle's own words: one pattern per written form, fields as text.
_MONTHS = "'janfebmaraprmayjunjulaugsepoctnovdec'"
_Z = r"\s?(z|[a-z]{{2,4}}|[+-]\d\d:?\d\d|[a-z]+/[a-z_]+)?"


def _form(pattern: str, y: int, mo: int, d: int, h: int, mi: int, s: int, ap: int, z: int) -> str:
    p = pattern.replace("{{", "{").replace("}}", "}")
    g = lambda i: f"regexp_extract(v, '{p}', {i})" if i else "''"
    return f"SELECT *, {g(y)} AS y, {g(mo)} AS mo, {g(d)} AS d, {g(h)} AS h, {g(mi)} AS mi, {g(s)} AS s, {g(ap)} AS ap, {g(z)} AS z FROM v WHERE regexp_matches(v, '{p}')"


_TIME_FORMS = " UNION ALL ".join([
    _form(r"^(\d{{4}})-(\d\d)-(\d\d)[t ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?" + _Z + "$", 1, 2, 3, 4, 5, 6, 0, 7),
    _form(r"^(\d{{4}})(\d\d)(\d\d)t(\d\d)(\d\d)(\d\d)(z)$", 1, 2, 3, 4, 5, 6, 0, 7),
    _form(r"^(?:[a-z]+, )?(\d{{1,2}})[ -]([a-z]+)[ -](\d{{4}}|\d\d) (\d\d):(\d\d)(?::(\d\d))?" + _Z + "$", 3, 2, 1, 4, 5, 6, 0, 7),
    _form(r"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) (\d{{1,2}}):(\d\d) ([ap])m$", 3, 1, 2, 4, 5, 0, 6, 0),
    _form(r"^([a-z]+) (\d{{1,2}}), (\d{{4}}) (\d{{1,2}}):(\d\d) ([ap])\.m\." + _Z + "$", 3, 1, 2, 4, 5, 0, 6, 7),
])
_DATE_FORMS = " UNION ALL ".join([
    _form(r"^([a-z]+)\.? (\d{{1,2}})(?:st|nd|rd|th)?(?:, ?| )(\d{{4}})(?:\.|, .*)?$", 3, 1, 2, 0, 0, 0, 0, 0),
    _form(r"^(?:the )?(\d{{1,2}})(?:st|nd|rd|th)?(?: day of)? ([a-z]+),? (\d{{4}})$", 3, 2, 1, 0, 0, 0, 0, 0),
    _form(r"^(\d{{4}})-?(\d\d)-?(\d\d)$", 1, 2, 3, 0, 0, 0, 0, 0),
    _form(r"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})$", 3, 1, 2, 0, 0, 0, 0, 0),
])
_BLANK = r"'[\s\x{A0}]+'"


def _times(rows: str, keys: str) -> str:
    """SQL giving ``keys, utc`` of ``rows`` (keys, value, zone)."""
    month = f"CASE WHEN mo BETWEEN '00' AND '99' THEN mo ELSE CAST((instr({_MONTHS}, substr(mo, 1, 3)) + 2) // 3 AS VARCHAR) END"
    hour = "CASE WHEN ap = '' THEN h WHEN CAST(h AS INTEGER) BETWEEN 1 AND 12 THEN CAST(CAST(h AS INTEGER) % 12 + CASE WHEN ap = 'p' THEN 12 ELSE 0 END AS VARCHAR) END"
    return f"""
  SELECT {keys}, utc FROM (
    WITH v AS (SELECT *, lower(trim(regexp_replace(value, {_BLANK}, ' ', 'g'))) AS v FROM ({rows})),
    f AS ({_TIME_FORMS}),
    w AS (SELECT *, TRY_CAST((CASE WHEN length(y) = 2 THEN '20' || y ELSE y END) || '-' || lpad({month}, 2, '0') || '-' || lpad(d, 2, '0') || ' ' ||
                 lpad({hour}, 2, '0') || ':' || mi || ':' || (CASE WHEN s = '' THEN '00' ELSE s END) AS TIMESTAMP) AS wall,
                 CASE WHEN z IN ('z', 'utc', 'ut', 'gmt') THEN 0 WHEN z = 'est' THEN -300 WHEN z = 'edt' THEN -240 WHEN z = 'cst' THEN -360 WHEN z = 'cdt' THEN -300
                      WHEN z[1] IN ('+', '-') THEN CAST(z[1] || '1' AS INTEGER) * (CAST(z[2:3] AS INTEGER) * 60 + CAST(z[-2:] AS INTEGER)) END AS minutes,
                 CASE WHEN z = '' THEN coalesce(zone, 'UTC') WHEN contains(z, '/') THEN z END AS region
          FROM f),
    u AS (SELECT *, CASE WHEN minutes IS NOT NULL THEN wall - to_minutes(minutes)
                         WHEN region IS NOT NULL THEN CASE WHEN timezone(region, timezone(region, wall) - INTERVAL 1 HOUR) = wall THEN timezone('UTC', timezone(region, wall) - INTERVAL 1 HOUR)
                                                           ELSE timezone('UTC', timezone(region, wall)) END END AS utc FROM w WHERE wall IS NOT NULL)
    SELECT {keys}, utc FROM u WHERE utc IS NOT NULL
    UNION ALL SELECT {keys}, make_timestamp(CAST(v AS BIGINT) * CASE WHEN length(v) = 10 THEN 1000000 ELSE 1000 END) FROM v WHERE regexp_matches(v, '^([0-9]{{10}}|[0-9]{{13}})$'))"""


_P1 = f"""
SELECT src_table, row_id, strftime(utc, '%Y-%m-%dT%H:%M:%SZ') AS normal_form FROM ({_times("""
    SELECT DISTINCT 'source_files' AS src_table, entry_id AS row_id, modified AS value, listing_zone AS zone FROM source_files
    UNION ALL SELECT DISTINCT 'feed_events', event_id, published, 'UTC' FROM feed_events""", "src_table, row_id")})
UNION ALL
SELECT 'history_entries', row_id, strftime(day, '%Y-%m-%d') FROM (
  WITH v AS (SELECT *, lower(trim(regexp_replace(value, {_BLANK}, ' ', 'g'))) AS v FROM (SELECT DISTINCT entry_id AS row_id, effective_raw AS value FROM history_entries)),
  f AS ({_DATE_FORMS})
  SELECT row_id, TRY_CAST(y || '-' || lpad(CASE WHEN mo BETWEEN '00' AND '99' THEN mo ELSE CAST((instr({_MONTHS}, substr(mo, 1, 3)) + 2) // 3 AS VARCHAR) END, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day FROM f)
WHERE day IS NOT NULL"""

_P3 = f"""
WITH ok AS (SELECT source, run_id, min(started_at) AS began FROM runs GROUP BY source, run_id HAVING max(CASE WHEN lower(trim(status)) = 'ok' THEN 1 ELSE 0 END) = 1),
l AS (SELECT DISTINCT run_id, source, name, size, lower(nullif(trim(sha256), '')) AS sha, modified, listing_zone FROM source_files),
t AS ({_times("SELECT DISTINCT modified AS key, listing_zone, modified AS value, listing_zone AS zone FROM source_files WHERE modified IS NOT NULL", "key, listing_zone")}),
m AS (SELECT l.run_id, l.source, l.name, l.size, l.sha, t.utc, ok.began FROM l JOIN ok USING (source, run_id)
      LEFT JOIN t ON t.key = l.modified AND t.listing_zone IS NOT DISTINCT FROM l.listing_zone),
p AS (SELECT *, lag(size) OVER w AS psize, lag(sha) OVER w AS psha, lag(utc) OVER w AS putc, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY source, name ORDER BY began, run_id))
SELECT run_id, source, name FROM p
WHERE n = 1 OR CASE WHEN sha IS NOT NULL AND psha IS NOT NULL THEN sha <> psha ELSE size IS DISTINCT FROM psize OR utc IS DISTINCT FROM putc END"""

_P3_LEDGER = f"""
WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY began, run_id) AS INTEGER) AS token FROM (
  SELECT source, run_id, min(started_at) AS began, max(CASE WHEN lower(trim(status)) = 'ok' THEN 1 ELSE 0 END) = 1 AS ok FROM runs GROUP BY source, run_id)),
l AS (SELECT DISTINCT run_id, source, name, size, lower(nullif(trim(sha256), '')) AS sha, modified, listing_zone FROM source_files),
t AS ({_times("SELECT DISTINCT modified AS key, listing_zone, modified AS value, listing_zone AS zone FROM source_files WHERE modified IS NOT NULL", "key, listing_zone")}),
m AS (SELECT l.source, l.name, r.token, r.ok, {{'size': l.size, 'sha': l.sha, 'utc': t.utc}} AS x FROM l JOIN r USING (source, run_id)
      LEFT JOIN t ON t.key = l.modified AND t.listing_zone IS NOT DISTINCT FROM l.listing_zone),
p AS (SELECT *, last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER w AS d, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w, 0) AS good
      FROM m WINDOW w AS (PARTITION BY source, name ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, d IS NULL OR CASE WHEN x.sha IS NOT NULL AND d.sha IS NOT NULL THEN x.sha <> d.sha ELSE x.size IS DISTINCT FROM d.size OR x.utc IS DISTINCT FROM d.utc END AS work FROM p),
a AS (SELECT *, sum(CASE WHEN work THEN 1 ELSE 0 END) OVER (PARTITION BY source, name, good) AS tries, row_number() OVER (PARTITION BY source, name ORDER BY token DESC) AS n,
             coalesce(max(CASE WHEN work THEN token END) OVER (PARTITION BY source, name), 0) AS held FROM k)
SELECT source, name, CASE WHEN work AND NOT ok THEN 'leased' ELSE 'done' END AS state, CAST(held AS INTEGER) AS token, CAST(CASE WHEN ok THEN 0 ELSE tries END AS INTEGER) AS attempts FROM a WHERE n = 1"""

ORACLES = {"p3_ledger": _P3_LEDGER, "p1_found": _P1, "p2_found": _P2, "p3_found": _P3, "p4_found": _P4, "p4_counts": _P4_COUNTS, "p5_found": _P5}
