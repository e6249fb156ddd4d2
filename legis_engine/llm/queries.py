"""Driver queries of the problems on language-model text, with SQL that finds the same by force:
all runs of words and all windows of characters. A tokenizer has no SQL form; it is tested
against the plain encoder and by round trips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .encoding import encode_corpus
from .leakage import leaked_items
from .spans import shared_spans


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
_P7 = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM eval_items) WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT item_id, w, least(12, len(w)) AS m, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT m FROM ig),
d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, m, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d JOIN s ON len(w) >= m))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (m, g)"""

_P8 = r"""
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400),
c AS (SELECT doc_id, b * 1000 AS base, substr(text, CAST(b * 1000 + 1 AS BIGINT), 1399) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 400) // 1000 + 1)) AS b FROM t)),
w AS (SELECT doc_id, base + k - 1 AS pos, md5(substr(part, k, 400)) AS h FROM (SELECT doc_id, base, part, unnest(range(1, least(1000, length(part) - 399) + 1)) AS k FROM c)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
p AS (SELECT DISTINCT doc_id, pos FROM w JOIN s USING (h)),
g AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 400 THEN 0 ELSE 1 END AS n FROM p),
r AS (SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_pos, CAST(max(pos) + 400 AS BIGINT) AS end_pos FROM r GROUP BY doc_id, run"""

ORACLES: dict[str, str] = {"p7_found": _P7, "p8_found": _P8}
