"""Citation grammar as column expressions (no Python workers).

Every function takes and returns Columns. Text is first collapsed: all white space in the
Unicode sense, and the four ASCII separators, become single blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token shapes of the citation grammar.
MCL_TOKEN = r"[0-9]{1,3}[A-Za-z]?\.[0-9]{1,5}[A-Za-z]{0,3}"
MCL_LIVE = rf"(?!0{{1,3}}[A-Za-z]?\.){MCL_TOKEN}"  # chapter 0 does not exist
SPACE = r"(?U)[\s\x{1C}-\x{1F}]+"


def collapse(c: Column) -> Column:
    """White space runs to one blank, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def roman_to_int(c: Column) -> Column:
    """Roman numeral (letters I V X L C, subtractive) to int; digits pass through."""
    value = lambda x: (
        F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).otherwise(0)
    )
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))
    folded = F.aggregate(
        F.split(F.reverse(F.upper(c)), ""),
        zero,
        lambda a, x: F.struct(
            (a["total"] + F.when(value(x) >= a["prev"], value(x)).otherwise(-value(x))).alias("total"),
            F.greatest(a["prev"], value(x)).alias("prev"),
        ),
        lambda a: a["total"],
    )
    return F.when(c.rlike("^[0-9]+$"), F.expr("null").cast("int")).otherwise(folded)


def article_number(c: Column) -> Column:
    """Article token, digits or roman, as a digit string."""
    return F.when(c.rlike("^[0-9]+$"), c.cast("int").cast("string")).otherwise(roman_to_int(c).cast("string"))


def mcl_key(token: Column) -> Column:
    """Canonical key of a section token: chapter letter upper, section letters lower."""
    bare = F.regexp_extract(token, rf"^(?:{MCL_TOKEN})", 0)
    return F.concat(
        F.lit("MCL "), F.upper(F.substring_index(bare, ".", 1)), F.lit("."), F.lower(F.substring_index(bare, ".", -1))
    )


def mcr_key(token: Column) -> Column:
    """Canonical key of a court rule: its letter is upper case, however it was written."""
    return F.concat(F.lit("MCR "), F.upper(token))


def const_key(article: Column, section: Column) -> Column:
    return F.when(
        F.lower(F.trim(article)) == "schedule", F.concat(F.lit("Const 1963, Schedule, § "), F.lower(section))
    ).otherwise(F.concat(F.lit("Const 1963, art "), article_number(article), F.lit(", § "), F.lower(section)))


# Full-match shapes of user input, tried in this order.
_MCL_INPUT = rf"(?i)^(?:MCL ?)?({MCL_LIVE})(?: ?\(.*\))?(?: ?et seq\.?)?$"
_MCR_INPUT = r"(?i)^MCR ?([0-9]{1,2}\.[0-9]{1,3}[A-Za-z]?)(?: ?\(.*\))?(?: ?et seq\.?)?$"
_MRE_INPUT = r"(?i)^MRE ?([0-9]{3,4})(?: ?\(.*\))?(?: ?et seq\.?)?$"
_CONST_INPUT = (
    r"(?i)^(?:Const\.? ?1963|1963 ?Const\.?),? ?(?:art(?:icle)?\.? ?([IVXLC]+|[0-9]+)|(Schedule)) ?,? ?§ ?"
    r"([0-9]+[A-Za-z]?)(?: ?\(.*\))?(?: ?et seq\.?)?$"
)
_ACT_INPUT = r"(?i)^([0-9]{4}) ?PA ?(?:No\.? ?)?([0-9]{1,4})$"
_ACT_WORDS = r"(?i)^(?:Public )?Act (?:No\.? ?)?([0-9]{1,4}) of (?:the Public Acts of )?([0-9]{4})$"


def citation_struct(text: Column) -> Column:
    """``struct(source, canonical)`` of a citation in any spelling, or null."""
    s = collapse(text)
    one = lambda src, key: F.struct(F.lit(src).alias("source"), key.alias("canonical"))
    article = F.coalesce(
        F.nullif(F.regexp_extract(s, _CONST_INPUT, 1), F.lit("")), F.regexp_extract(s, _CONST_INPUT, 2)
    )
    return (
        F.when(s.rlike(_MCL_INPUT), one("mcl", mcl_key(F.regexp_extract(s, _MCL_INPUT, 1))))
        .when(s.rlike(_MCR_INPUT), one("mcr", mcr_key(F.regexp_extract(s, _MCR_INPUT, 1))))
        .when(s.rlike(_MRE_INPUT), one("mre", F.concat(F.lit("MRE "), F.regexp_extract(s, _MRE_INPUT, 1))))
        .when(s.rlike(_CONST_INPUT), one("const", const_key(article, F.regexp_extract(s, _CONST_INPUT, 3))))
    )


def normalize_citation(text: Column) -> Column:
    """Canonical citation of a section, rule or constitution reference; null if it is none."""
    return citation_struct(text)["canonical"]


def normalize_act(text: Column) -> Column:
    """Canonical ``yyyy PA n``; null if the text names no act."""
    s = collapse(text)
    by = lambda p, y, n: F.concat(
        F.regexp_extract(s, p, y), F.lit(" PA "), F.regexp_extract(s, p, n).cast("int").cast("string")
    )
    return F.when(s.rlike(_ACT_INPUT), by(_ACT_INPUT, 1, 2)).when(s.rlike(_ACT_WORDS), by(_ACT_WORDS, 2, 1))


def sort_key(citation: Column) -> Column:
    """``struct(n1, l1, n2, l2)`` in natural order; schedules come after every article."""
    dotted = r"([0-9]+)([A-Za-z]?)\.([0-9]+)([a-z]*)"
    const = r"(?i)^Const\s+1963,\s*(?:art\s+([0-9]+)|Schedule),\s*§\s*([0-9]+)([A-Za-z]?)$"
    n = lambda p, g: F.regexp_extract(citation, p, g).try_cast("int")
    make = lambda a, b, c, d: F.struct(a.alias("n1"), b.alias("l1"), c.alias("n2"), d.alias("l2"))
    nums = F.regexp_extract_all(citation, F.lit("([0-9]+)"), F.lit(1))
    nth = lambda i: F.coalesce(F.get(nums, i).try_cast("int"), F.lit(0))
    return (
        F.when(
            citation.rlike(dotted),
            make(n(dotted, 1), F.upper(F.regexp_extract(citation, dotted, 2)), n(dotted, 3), F.regexp_extract(citation, dotted, 4)),
        )
        .when(
            citation.rlike(const),
            make(F.coalesce(n(const, 1), F.lit(9999)), F.lit(""), n(const, 2), F.lower(F.regexp_extract(citation, const, 3))),
        )
        .when(citation.isNotNull(), make(nth(0), F.lit(""), nth(1), F.lit("")))
    )


def chapter_of(citation: Column) -> Column:
    """Chapter of a canonical section citation, null for the other kinds."""
    return F.nullif(F.regexp_extract(citation, r"^MCL ([0-9]{1,3}[A-Z]?)\.", 1), F.lit(""))


_SECTION_NAME = r"^mcl-([0-9]{1,3}[A-Za-z]?)-([0-9]{1,5}[A-Za-z]{0,3})(?:-([a-z]+)|(\[[A-Za-z0-9]+\]))?$"
_ACT_NAME = r"(?i)^mcl-act-([0-9]+)-of-([0-9]{4})$"


def section_of_object(name: Column) -> Column:
    """``struct(citation, variant)`` of a section's object name; variant words are lower case, so
    division names do not match. Null if the name is none."""
    g = lambda i: F.regexp_extract(name, _SECTION_NAME, i)
    cite = normalize_citation(F.concat(g(1), F.lit("."), g(2)))
    return F.when(
        name.rlike(_SECTION_NAME) & cite.isNotNull(),
        F.struct(cite.alias("citation"), F.nullif(F.concat(g(3), g(4)), F.lit("")).alias("variant")),
    )


def act_of_object(name: Column) -> Column:
    g = lambda i: F.regexp_extract(name, _ACT_NAME, i)
    return F.when(name.rlike(_ACT_NAME), F.concat(g(2), F.lit(" PA "), g(1).cast("int").cast("string")))
