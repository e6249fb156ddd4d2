"""Full-text search: postings, phrases, boolean queries, BM25 over weighted fields, snippets.

A query names few terms, so one pass keeps only their occurrences, counts each phrase per
document and field, and a single aggregation brings a document's phrase counts side by side;
the boolean expression is then a plain filter over those columns.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import porter, porter_udf
from ..session import ship

WEIGHTS = {"citation": 10.0, "catchline": 5.0, "text": 1.0}
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _plain_letters() -> tuple[str, str]:
    """Latin letters with accents and the letters without, from their decompositions."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(cp).lower()
        base = unicodedata.normalize("NFD", low)[0]
        if len(low) == 1 and base != low and base.isascii():
            pairs.append((low, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _plain_letters()


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.regexp_replace(c, r"\p{Mn}+", "")), ACCENTED, BARE)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def fold_text(s: str) -> list[str]:
    """The same tokens of a driver-side string (a query)."""
    low = "".join(ch for ch in unicodedata.normalize("NFC", s) if unicodedata.category(ch) != "Mn").lower()
    low = low.translate(str.maketrans(ACCENTED, BARE))
    runs = "".join(ch if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co" else " " for ch in low)
    return [t for t in runs.split(" ") if t]


def postings(docs: DataFrame, id_col: str, fields: list[str], stem: bool = True) -> DataFrame:
    """``term, id, field, positions``. Stems are made of the distinct terms only."""
    rows = docs.select(id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])).alias("f"))
    flat = rows.select(id_col, "f.field", F.posexplode("f.t").alias("pos", "term"))
    # A document's occurrences of a word lie together, so they are one row before anything travels.
    per = flat.groupBy("term", id_col, "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    if not stem:
        return per
    ship(docs.sparkSession)
    stems = flat.select("term").distinct().withColumn("stem", porter_udf("term"))
    named = per.join(stems, "term").groupBy(F.col("stem").alias("term"), id_col, "field")
    return named.agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def doc_stats(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``id, tokens``: tokens over all fields of each document."""
    total = None
    for f in fields:
        n = F.size(tokens(F.col(f)))
        total = n if total is None else total + n
    return docs.select(id_col, total.cast("bigint").alias("tokens"))


class QueryError(ValueError):
    pass


@dataclass
class Query:
    """Phrases (token lists) and a boolean expression over their indexes."""

    phrases: list[list[str]] = field(default_factory=list)
    tree: tuple | None = None


def parse_query(text: str, stem: bool = True) -> Query:
    """Words and "phrases" with upper-case AND, OR, NOT.

    Neighbours without an operator bind tightest (all must match), then NOT, AND, OR. Leading and
    trailing operators are dropped; two operators in a row and empty queries are errors. A phrase
    of signs only matches nothing alone and is ignored among neighbours.
    """
    parts: list[tuple[str, str]] = []
    for phrase, word in re.findall(r'"([^"]+)"|(\S+)', text):
        if phrase:
            parts.append(("phrase", phrase))
        elif word in ("AND", "OR", "NOT"):
            parts.append(("op", word))
        elif bare := re.sub(r"""["'*()^:{}\[\]]""", " ", word).strip():
            parts.append(("phrase", bare))
    while parts and parts[-1][0] == "op":
        parts.pop()
    while parts and parts[0][0] == "op":
        parts.pop(0)
    if not parts:
        raise QueryError("Empty search query")
    q = Query()

    def implicit(items: list[tuple[str, str]]) -> tuple:
        if not items:
            raise QueryError("Could not run that search: two operators in a row")
        leaves = []
        for _, p in items:
            toks = [porter(t) if stem else t for t in fold_text(p)]
            if toks:
                q.phrases.append(toks)
                leaves.append(("p", len(q.phrases) - 1))
        return ("and", leaves) if leaves else ("none",)

    def level(items: list[tuple[str, str]], ops: list[str]) -> tuple:
        if not ops:
            return implicit(items)
        groups: list[list[tuple[str, str]]] = [[]]
        for it in items:
            if it == ("op", ops[0]):
                groups.append([])
            else:
                groups[-1].append(it)
        subs = [level(g, ops[1:]) for g in groups]
        return subs[0] if len(subs) == 1 else (ops[0].lower(), subs)

    q.tree = level(parts, ["OR", "AND", "NOT"])
    return q


def _matches(tree: tuple, has: list[Column]) -> Column:
    kind = tree[0]
    if kind == "p":
        return has[tree[1]]
    if kind == "none":
        return F.lit(False)
    subs = [_matches(t, has) for t in tree[1]]
    out = subs[0]
    for s in subs[1:]:
        out = out & ~s if kind == "not" else out & s if kind == "and" else out | s
    return out


def _counted(tree: tuple, has: list[Column], above: Column) -> dict[int, Column]:
    """Where each phrase counts towards the score: every group it stands in must match, and what
    is excluded never counts."""
    if tree[0] == "p":
        return {tree[1]: above & has[tree[1]]}
    if tree[0] == "none":
        return {}
    here = above & _matches(tree, has)
    out: dict[int, Column] = {}
    for sub in tree[1][:1] if tree[0] == "not" else tree[1]:
        out |= _counted(sub, has, here)
    return out


def _back(positions: Column, i: int) -> Column:
    return F.transform(positions, lambda p: p - i)


def match(index: DataFrame, id_col: str, query: Query) -> DataFrame:
    """``id, f0, f1, ...``: weighted occurrences of each phrase in each document that has any."""
    wanted = sorted({t for p in query.phrases for t in p})
    near = index.where(F.col("term").isin(wanted))
    at = lambda t: F.max(F.when(F.col("term") == t, F.col("positions")))
    per = near.groupBy(id_col, "field").agg(*[F.coalesce(at(t), F.array().cast("array<int>")).alias(f"t{i}") for i, t in enumerate(wanted)])
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[F.col("field")]
    cols = []
    for k, phrase in enumerate(query.phrases):
        hits = F.col(f"t{wanted.index(phrase[0])}")
        for i, t in enumerate(phrase[1:], 1):
            hits = F.array_intersect(hits, _back(F.col(f"t{wanted.index(t)}"), i))
        cols.append(F.sum(F.coalesce(weight, F.lit(1.0)) * F.size(hits)).alias(f"f{k}"))
    return per.groupBy(id_col).agg(*cols)


def bm25(matched: DataFrame, stats: DataFrame, id_col: str, query: Query) -> DataFrame:
    """``id, score`` of the documents the expression accepts; lower is better.

    The number of documents counts all indexed ones; phrases in more than half of them get the
    least weight instead of a negative one. A phrase counts where its whole group matches.
    """
    n = len(query.phrases)
    if n == 0:
        return matched.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    corpus = stats.agg(F.count(F.lit(1)).alias("_n"), F.avg("tokens").alias("_avg"))
    dfs = matched.agg(*[F.coalesce(F.sum((F.col(f"f{k}") > 0).cast("int")), F.lit(0)).alias(f"n{k}") for k in range(n)])
    # Both sides are one row by construction.
    one = corpus.join(F.broadcast(dfs), F.lit(True))
    has = [F.col(f"f{k}") > 0 for k in range(n)]
    counted = _counted(query.tree, has, F.lit(True))
    d = matched.where(_matches(query.tree, has)).join(stats, id_col).join(F.broadcast(one), F.lit(True))
    score = F.lit(0.0)
    for k, where in counted.items():
        raw = F.log((F.col("_n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        f = F.when(where, F.col(f"f{k}")).otherwise(0.0)
        norm = f + K1 * (1 - B + B * F.col("tokens") / F.col("_avg"))
        score = score - idf * f * (K1 + 1) / norm
    return d.select(id_col, score.alias("score"))


def snippet(text: Column, query: Query, stem: bool = True, width: int = 24) -> Column:
    """The window of ``width`` words with the most hits, hits in brackets.

    A word is a hit if one of its tokens has a stem of the query (without stems: is one of its
    terms). A snippet is made for the few texts that are shown.
    """
    terms = sorted({t for p in query.phrases for t in p})
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    ws = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")
    marks = _hit_marks(ws, terms) if stem else F.transform(ws, lambda w: F.arrays_overlap(tokens(w), wanted).cast("int"))
    marked = F.arrays_zip(ws.alias("w"), marks.alias("m"))
    # Bound once: windows and brackets look at the same list.
    return F.element_at(F.transform(F.array(marked), lambda a: _window(a, width)), 1)


def _window(marked: Column, width: int) -> Column:
    n = F.size(marked)
    at = F.filter(F.transform(marked, lambda x, i: F.when((x["m"] == 1) | (i == 0), i)), lambda i: i.isNotNull())
    scored = F.transform(at, lambda i: F.struct(F.aggregate(F.slice(marked, i + 1, width), F.lit(0), lambda a, x: a + x["m"]).alias("hits"), (-i).alias("neg")))
    best = -F.array_max(scored)["neg"]
    shown = F.transform(F.slice(marked, best + 1, width), lambda x: F.when(x["m"] == 1, F.concat(F.lit("["), x["w"], F.lit("]"))).otherwise(x["w"]))
    return F.concat(F.when(best > 0, "… ").otherwise(""), F.array_join(shown, " "), F.when(best + width < n, " …").otherwise(""))


def _hit_marks(ws: Column, terms: list[str]) -> Column:
    """1 for each word with a token of a wanted stem, else 0."""

    @F.pandas_udf("array<int>")
    def marks(words: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def hit(w: str) -> int:
            if w not in known:
                known[w] = int(any(porter(t) in wanted for t in fold_text(w)))
            return known[w]

        return words.map(lambda x: [hit(w) for w in x])

    wanted = set(terms)
    return marks(ws)


def normalise_chapter(text: str) -> str:
    """"chapter 750", "chap 767a" and "750" name the same chapter."""
    return re.sub(r"^(chapter|chap)\.?", "", str(text).strip().lower()).strip().upper()


def search(
    docs: DataFrame, query: str, id_col: str = "doc_id", source: str | None = None, chapter: str | None = None,
    include_repealed: bool = False, limit: int = 10, stem: bool = True, index: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """Ranked results over ordinary active documents: citation, source, chapter, catchline,
    status, snippet, url, score. ``docs`` has the fields of WEIGHTS and source, chapter, status,
    active, variant, url. ``limit`` is clamped to 1..50; ties go by id.

    ``index`` and ``stats`` are the stored postings and token counts of those documents; a stored
    index is read by a filter on its terms. Without them both are made of ``docs``.
    """
    fields = list(WEIGHTS)
    q = parse_query(query, stem)
    held = docs.where(F.col("active") & (F.coalesce("variant", F.lit("")) == ""))
    idx = index if index is not None else postings(held, id_col, fields, stem)
    counts = stats if stats is not None else doc_stats(held, id_col, fields)
    hits = bm25(match(idx, id_col, q), counts, id_col, q)
    meta = held
    if source:
        meta = meta.where(F.col("source") == source.lower())
    if chapter:
        meta = meta.where(F.col("chapter") == normalise_chapter(chapter))
    if not include_repealed:
        meta = meta.where(F.col("status") == "active")
    ship(docs.sparkSession)
    # Ranked without the texts; those are fetched for the at most 50 results.
    top = hits.join(meta.select(id_col), id_col).orderBy("score", id_col).limit(max(1, min(int(limit), 50)))
    shown = held.join(F.broadcast(top), id_col).withColumn("snippet", snippet(F.col("text"), q, stem))
    return shown.select(id_col, "citation", "source", "chapter", "catchline", "status", "snippet", "url", "score").orderBy("score", id_col)
