"""The change feed: items classified into events, logged once, summarised, turned into a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import MCL_TOKEN, collapse, normalize_citation

EVENT = "struct<kind:string,citation:string,act_citation:string,variant:string>"

# What a title can be about, by the shape of the identifier in it. Parts of a node behind
# its act and year are digits or upper case, so the lower-case word of a variant is never one.
_ACT_ID = r"^Act\.([0-9]+)\.of\.([0-9]{4})$"
_ERO_ID = r"^E\.R\.O\.No\.[0-9]{4}\.[0-9]+$"
_NODE_ID = r"^([0-9]{1,4})\.(1[89][0-9]{2}|20[0-9]{2})(?:\.(?:[0-9]+|[A-Z][A-Z-]*))+$"
_INITIATED = r"^Initiated\.Law\.[0-9]+\.of\.[0-9]{4}$"
_SECTION_ID = rf"^({MCL_TOKEN})(?:\.([A-Za-z]+)|\[([A-Za-z0-9]+)\])?$"
_STATUS = r"(?i)^(Expired|Repealed|Reserved|Rescinded|Superseded)\b"
_NODE_OBJECT = r"(?i)^mcl-([0-9]{1,4})-([0-9]{4})-"
_HEADING = r"^(.+?) - ([A-Za-z ]+)$"


def object_name(link: Column, guid: Column) -> Column:
    """The object a feed item points to: from a query parameter, else a bare identifier."""
    q = lambda c: F.try_url_decode(F.nullif(F.regexp_extract(c, r"[?&]objectName=([^&#]*)", 1), F.lit("")))
    return F.coalesce(q(link), q(guid), F.when(guid.startswith("mcl-"), guid))


def status_hint(description: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(description, _STATUS, 1), F.lit("")))


def _told(title: Column) -> tuple[Column, Column, Column]:
    """(whether the title tells of a section node, its identifier, the verb).

    Word by word: "Section", the identifier, then "-" or "has been", then what happened in letters.
    """
    w = F.split(title, " ")
    at = lambda i: F.get(w, F.lit(i))
    passive = (at(2) == "has") & (at(3) == "been")
    verb = F.array_join(F.slice(w, F.when(passive, 5).otherwise(4), F.size(w)), "_")
    is_section = F.coalesce((at(0) == "Section") & (passive | (at(2) == "-")) & verb.rlike("^[A-Za-z_]+$"), F.lit(False))
    return is_section, at(1), F.lower(verb)


def heading(title: Column, obj: Column) -> Column:
    """The name in a title that tells of a heading ("FEES - added"), else null."""
    t = collapse(title)
    return F.when(~_told(t)[0] & obj.isNotNull() & t.rlike(_HEADING), F.trim(F.regexp_extract(t, _HEADING, 1)))


def classify(title: Column, obj: Column) -> Column:
    """``struct(kind, citation, act_citation, variant)`` of an item; the first shape that fits wins.

    A null title, and one of no known shape, is ``unrecognized``.
    """
    t = collapse(F.coalesce(title, F.lit("")))
    is_section, ident, verb = _told(t)
    none = F.lit(None).cast("string")
    ev = lambda kind, cite=none, act=none, var=none: F.struct(kind.alias("kind"), cite.alias("citation"), act.alias("act_citation"), var.alias("variant"))
    act = lambda c, p: F.concat(F.regexp_extract(c, p, 2), F.lit(" PA "), F.regexp_extract(c, p, 1).try_cast("int").cast("string"))
    did = lambda what: F.concat(F.lit(f"{what}_"), verb)
    done = F.concat(F.lit("heading_"), F.regexp_replace(F.lower(F.trim(F.regexp_extract(t, _HEADING, 2))), " ", "_"))
    dotted, braced = F.lower(F.regexp_extract(ident, _SECTION_ID, 2)), F.regexp_extract(ident, _SECTION_ID, 3)
    cite = normalize_citation(F.regexp_extract(ident, _SECTION_ID, 1))
    variant = F.when(dotted != "", dotted).when(braced != "", F.concat(F.lit("["), braced, F.lit("]")))
    return (
        F.when(heading(t, obj).isNotNull(), ev(done, act=F.when(obj.rlike(_NODE_OBJECT), act(obj, _NODE_OBJECT))))
        .when(~is_section, ev(F.lit("unrecognized")))
        .when(ident.rlike(_ACT_ID), ev(did("act"), act=act(ident, _ACT_ID)))
        .when(ident.rlike(_ERO_ID), ev(did("ero")))
        .when(ident.rlike(_NODE_ID), ev(did("heading"), act=act(ident, _NODE_ID)))
        .when(ident.rlike(_INITIATED), ev(did("initiated_law")))
        .when(ident.rlike(_SECTION_ID) & cite.isNotNull(), ev(verb, cite, var=variant))
        .otherwise(ev(F.lit("unrecognized")))
        .cast(EVENT)
    )


EVENT_KEY = ["feed_built_at", "raw_title", "object_name"]


def record(log: DataFrame, events: DataFrame) -> DataFrame:
    """The events not logged yet, each once; missing key parts compare equal."""
    k = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in EVENT_KEY]
    fresh = events.select("*", *k).dropDuplicates([f"_{c}" for c in EVENT_KEY])
    return fresh.join(log.select(*k).distinct(), [f"_{c}" for c in EVENT_KEY], "left_anti").drop(*[f"_{c}" for c in EVENT_KEY])


def summary_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n_events"))


def summary_by_chapter(events: DataFrame) -> DataFrame:
    chapter = F.regexp_extract("citation", r"^MCL ([0-9]+[A-Z]?)\.", 1)
    return events.where(F.col("citation").isNotNull()).groupBy(chapter.alias("chapter")).agg(F.count(F.lit(1)).alias("n_events"))


def _lists(events: DataFrame, lists: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``list, value``: each list's distinct values; one pass over the events."""
    entries = F.array(*[F.when(keep, F.struct(F.lit(name).alias("list"), value.alias("value"))) for name, (keep, value) in lists.items()])
    return events.select(F.inline(F.filter(entries, lambda e: e.isNotNull()))).distinct()


def summary_lists(events: DataFrame) -> DataFrame:
    """``list, value``: variant nodes, acts with events of their own, all acts touched, titles of no known shape."""
    act = F.col("act_citation")
    return _lists(events, {
        "variant_nodes": (F.col("variant").isNotNull(), F.concat_ws(" ", "citation", "variant")), "act_level_events": (F.col("kind").startswith("act_") & act.isNotNull(), act),
        "acts_touched": (act.isNotNull(), act), "unrecognized_titles": (F.col("kind") == "unrecognized", F.col("raw_title")),
    })


def work_lists(events: DataFrame) -> DataFrame:
    """``list, value`` of newly logged events: sections and objects to fetch again, acts to crawl
    again, titles somebody should look at."""
    cite = F.col("citation").isNotNull()
    return _lists(events, {
        "refetch_sections": (cite, F.col("citation")), "refetch_objects": (cite & F.col("object_name").isNotNull(), F.col("object_name")),
        "recrawl_acts": (F.col("act_citation").isNotNull(), F.col("act_citation")), "unrecognized": (F.col("kind") == "unrecognized", F.col("raw_title")),
    })


def resolve_chapters(events: DataFrame, documents: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``chapter, act_citation, mapped``: what to fetch again, and acts no chapter is known for.

    A section event names its own chapter; act and heading events mean every chapter where the
    act has documents or ranges.
    """
    own = events.where(F.col("citation").isNotNull()).select(F.regexp_extract("citation", r"^MCL ([0-9]+[A-Z]?)\.", 1).alias("chapter"), F.lit(None).cast("string").alias("act_citation"))
    acts = events.where(F.col("citation").isNull() & F.col("act_citation").isNotNull()).select("act_citation").distinct()
    known = documents.select("act_citation", "chapter")
    if ranges is not None:
        known = known.union(ranges.select("act_citation", "chapter"))
    by_act = acts.join(known.where(F.col("chapter").isNotNull()).distinct(), "act_citation", "left").select("chapter", "act_citation")
    return own.distinct().unionByName(by_act).withColumn("mapped", F.col("chapter").isNotNull())
