"""Cross-reference and range extraction: one text to many references, all in column expressions.

A chain is a lead-in, a first section token and further tokens after separators. One expression
finds all chains (captured inside a lookahead, so a lead-in within a chain still starts its own),
a second one takes a chain apart into (separator, token) pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .citations import MCL_LIVE, MCL_TOKEN, chapter_of, collapse, const_key, mcl_key, mcr_key

_SUBDIV = r"(?:\([^)]*\))*+"
_GAP = r"(?>\s*,\s*(?:(?:and|or)\s+)?|\s*&\s*|\s*[-–—]\s*|\s+(?:and|or|to|through)\s+)"
_ITEM = rf"(?>{MCL_LIVE}){_SUBDIV}"
_CHAIN = rf"{_ITEM}(?>{_GAP}{_ITEM})*+"
_LAWS = r"\s+of\s+the\s+Michigan\s+Compiled\s+Laws"
_SPAN_WORDS = ["to", "through", "-", "–", "—"]

_MCL_CHAIN = rf"(?iU)\bMCL\s+(?=({_CHAIN}))"
_BEING_CHAIN = rf"(?iU)\bbeing\s+sections?\s+(?=({_CHAIN}){_LAWS})"
_PAIR = rf"(?iU)({_GAP})?({_ITEM})"

# The written forms of acts, court and evidence rules and the constitution. They must be
# those of the corpus' own citation grammar, or other references would be found.
_ACT_A = r"(?U)\b([0-9]{4})\s+PA\s+([0-9]{1,4})\b"
_ACT_B = r"(?iU)\bAct\s+(?:No\.\s+)?([0-9]{1,4})\s+of\s+(?:the\s+Public\s+Acts\s+of\s+)?([0-9]{4})\b"
_MCR = r"(?U)\bMCR\s+([0-9]{1,2}\.[0-9]{1,3}[A-Za-z]?)"
_MRE = r"(?U)\bMRE\s+([0-9]{3,4})"
_CONST = r"(?iU)(?:\bConst\.?\s*1963|\b1963\s*Const\.?),?\s*(?:art(?:icle)?\.?\s*([IVX]+|[0-9]+)|(Schedule))\s*,?\s*§\s*([0-9]+[A-Za-z]?)"

REF = "array<struct<kind:string,key:string,raw:string,in_range:boolean>>"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ref(kind: str, key: Column, raw: Column, in_range: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), raw.alias("raw"),
        (F.lit(False) if in_range is None else in_range).alias("in_range"),
    )


def chain_tokens(chain: Column) -> Column:
    """``array<struct<sep, raw>>`` of a chain; dashes count as "to"."""
    pairs = F.arrays_zip(_all(chain, _PAIR, 1).alias("sep"), _all(chain, _PAIR, 2).alias("raw"))
    word = lambda p: F.lower(F.trim(F.regexp_replace(p["sep"], r"(?U)\s+", " ")))
    return F.transform(pairs, lambda p: F.struct(F.when(word(p).isin(*_SPAN_WORDS[2:]), "to").otherwise(word(p)).alias("sep"), p["raw"].alias("raw")))


def _chain_refs(chains: Column) -> Column:
    def one(chain: Column) -> Column:
        spans = lambda t: F.coalesce(t["sep"].isin("to", "through"), F.lit(False))
        refs = lambda ts: F.transform(ts, lambda t, i: _ref("mcl", mcl_key(t["raw"]), t["raw"], spans(t) | spans(F.get(ts, i + 1))))
        # The list is bound once: a token looks at its neighbour, which must not take the chain apart again.
        return F.flatten(F.transform(F.array(chain_tokens(chain)), refs))

    return F.flatten(F.transform(chains, one))


# The parts of a reference are taken from the reference found, not by scanning the text again.


def _pair_refs(text: Column, pattern: str, year: int, number: int) -> Column:
    part = lambda raw, i: F.regexp_extract(raw, pattern, i)
    key = lambda raw: F.concat(part(raw, year), F.lit(" PA "), part(raw, number).cast("int").cast("string"))
    return F.transform(_all(text, pattern, 0), lambda raw: _ref("public_act", key(raw), raw))


def _rule_refs(text: Column, pattern: str, kind: str, key: Callable[[Column], Column]) -> Column:
    return F.transform(_all(text, pattern, 0), lambda raw: _ref(kind, key(F.regexp_extract(raw, pattern, 1)), raw))


def _const_refs(text: Column) -> Column:
    part = lambda raw, i: F.regexp_extract(raw, _CONST, i)
    article = lambda raw: F.when(part(raw, 1) != "", part(raw, 1)).otherwise(part(raw, 2))
    return F.transform(_all(text, _CONST, 0), lambda raw: _ref("const", const_key(article(raw), part(raw, 3)), raw))


def section_chains(text: Column) -> Column:
    """Chains of sections that "MCL" leads in, each as it is written; null text: none."""
    return _all(F.coalesce(text, F.lit("")), _MCL_CHAIN, 1)


KINDS = ("mcl", "public_act", "mcr", "mre", "const")


def references_in(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """All references of a text in the order they are emitted, repeats included; null text: none.

    Only the scans of the wanted ``kinds`` are made.
    """
    t = F.coalesce(text, F.lit(""))
    scans = {
        "mcl": lambda: [_chain_refs(section_chains(text)), _chain_refs(_all(t, _BEING_CHAIN, 1))],
        "public_act": lambda: [_pair_refs(t, _ACT_A, 1, 2), _pair_refs(t, _ACT_B, 2, 1)],
        "mcr": lambda: [_rule_refs(t, _MCR, "mcr", mcr_key)], "mre": lambda: [_rule_refs(t, _MRE, "mre", lambda n: F.concat(F.lit("MRE "), n))],
        "const": lambda: [_const_refs(t)],
    }
    return F.concat(*[c for k in KINDS if k in kinds for c in scans[k]()]).cast(REF)


def extract_xrefs(df: DataFrame, id_col: str, text_col: str, self_col: str | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``id_col, seq, kind, key, raw, in_range``: distinct references of each row's text.

    Of references with equal kind, key and raw text the first counts. References to ``self_col``
    are dropped. Long documents stay whole; the reduction is per document and map-side first.
    """
    keep = [id_col, *([self_col] if self_col else [])]
    flat = df.select(*keep, F.posexplode(references_in(F.col(text_col), kinds)).alias("_pos", "_r")).select(*keep, "_pos", "_r.*")
    if self_col:
        flat = flat.where(F.col(self_col).isNull() | (F.col("key") != F.col(self_col)))
    return flat.groupBy(id_col, "kind", "key", "raw").agg(
        F.min("_pos").alias("seq"), F.min_by("in_range", "_pos").alias("in_range")
    ).select(id_col, "seq", "kind", "key", "raw", "in_range")


_REPEALED = rf"(?iU)(\bbeing\s+sections?\s+({_CHAIN}){_LAWS}\s*,?\s*(?:is|are)\s+(?:hereby\s+)?repealed)\b"

# The written forms of sections that have no text any more, in notes and in stub lines,
# with how far the word may stand behind the section (400 characters) and how much of its cause belongs to it (80).
_FORMER = (
    rf"(?isU)\bFormer\s+MCL\s+({MCL_TOKEN})(?:\s*(?:-|–|—|to)\s*({MCL_TOKEN}))?"
    r".{0,400}?\b(repealed|expired)\b(?:\s+(?:by|pursuant\s+to)\s+[^.;]{0,80})?"
)
_STUB = rf"(?iU)^\s*({MCL_TOKEN})(?:\s*(?:-|–|—|to|through)\s*({MCL_TOKEN}))?\s+(Repealed|Expired|Reserved|Rejected)\b(.*)$"


def _range(start: Column, end: Column, note: Column, status: Column) -> Column:
    return F.struct(
        start.alias("start_citation"), end.alias("end_citation"), collapse(note).alias("note"), status.alias("status"), chapter_of(start).alias("chapter")
    )


def narrative_ranges(text: Column, notes: Column) -> Column:
    """Spans that a section's prose repeals, and former sections that notes announce."""
    t, n = F.coalesce(text, F.lit("")), F.coalesce(notes, F.lit(""))
    repeals = F.arrays_zip(_all(t, _REPEALED, 1).alias("note"), _all(t, _REPEALED, 2).alias("chain"))

    def repeal(p: Column) -> Column:
        tokens = chain_tokens(p["chain"])
        return _range(mcl_key(F.get(tokens, 0)["raw"]), mcl_key(F.element_at(tokens, -1)["raw"]), p["note"], F.lit("repealed"))

    former = F.arrays_zip(_all(n, _FORMER, 1).alias("a"), _all(n, _FORMER, 2).alias("b"), _all(n, _FORMER, 3).alias("st"), _all(n, _FORMER, 0).alias("note"))
    return F.concat(
        F.transform(repeals, repeal),
        F.transform(former, lambda p: _range(mcl_key(p["a"]), mcl_key(F.when(p["b"] != "", p["b"]).otherwise(p["a"])), p["note"], F.lower(p["st"]))),
    )


def stub_range(line: Column) -> Column:
    """The range a whole line declares ("37.1-37.9 Repealed. ..."), or null."""
    g = lambda i: F.regexp_extract(line, _STUB, i)
    end = F.when(g(2) != "", g(2)).otherwise(g(1))
    return F.when(line.rlike(_STUB), _range(mcl_key(g(1)), mcl_key(end), line, F.lower(g(3))))
