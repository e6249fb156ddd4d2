"""The source registry: what a crawl is read from, always as the same DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.citations import collapse
from ..operators import feed as fd
from ..operators.manifest import listing_entries
from ..operators.merge import IntegrityError
from ..session import materialize, shared_dir
from . import chapters as ch
from .landing import Client, files_for, land_html, land_xml


@dataclass
class Crawl:
    """Documents (merge.DOC_SCHEMA), ranges and acts of one source, and what it covers."""

    name: str
    documents: DataFrame
    ranges: DataFrame | None = None
    acts: DataFrame | None = None
    complete: bool = True
    kinds: list[str] = field(default_factory=lambda: ["mcl"])
    chapters: list[str] | None = None
    currency: str | None = None


_DOC = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (
    "citation", "text", "catchline", "chapter", "history_note", "compilers_notes", "status", "act_citation", "act_name", "url", "effective_date", "variant", "kind",
)]))
_ACT = T.ArrayType(T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("title", T.StringType()),
    T.StructField("effective_date", T.StringType()), T.StructField("url", T.StringType()), T.StructField("affected_citations", T.ArrayType(T.StringType())),
]))
FIXTURE = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("complete", T.BooleanType()), T.StructField("documents", _DOC), T.StructField("public_acts", _ACT),
])


def json_fixture(spark: SparkSession, path: str) -> Crawl:
    """A folder with ``data.json``; the schema is stated, so nothing is inferred from the data."""
    raw = spark.read.schema(FIXTURE).option("multiLine", True).json(os.path.join(path, "data.json"))
    head = raw.select(F.coalesce("source", F.lit("mcl")).alias("source"), F.coalesce("complete", F.lit(True)).alias("complete")).first()
    e = raw.select(F.posexplode("documents").alias("ordinal", "d")).select(F.col("ordinal").cast("bigint"), F.lit(head.source).alias("source"), "d.*")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("catchline", "text", "history_note", "compilers_notes", "variant")}
    docs = e.withColumns(blank | {"status": F.coalesce("status", F.lit("active")), "kind": F.coalesce("kind", F.lit("section"))})
    acts = raw.select(F.posexplode("public_acts").alias("ordinal", "a")).select("ordinal", "a.*")
    return Crawl(head.source, docs, acts=acts, complete=head.complete, kinds=[head.source])


def chapter_folder(spark: SparkSession, path: str | list[str], kind: str, wanted: list[str] | None = None, base_url: str = "") -> Crawl:
    """Whole-chapter files of a folder (or those named). ``wanted`` keeps the files that cover one of
    the chapters; XML files that their head shows to hold another one are not parsed at all.

    The parse is written once and everything is derived from it; any problem stops the crawl.
    """
    rows = ch.parse_files(spark, path, kind, wanted)
    if wanted is not None:
        names = [c.upper() for c in wanted]
        own = F.upper(F.coalesce(F.regexp_extract("number", r"^([0-9]{1,3}[A-Za-z]?)\.", 1), F.lit("")))
        rows = materialize(rows, "chapter_rows")
        keep = rows.where(F.col("chapter").isin(names) | (F.col("multi") & own.isin(names)) | (F.col("row") == "problem")).select("file").distinct()
        rows = rows.join(keep, "file", "left_semi")
    rows = materialize(rows, "chapter_rows")
    recs = ch.records(rows, base_url)
    bad = ch.problems(rows, recs).limit(5).collect()
    if bad:
        raise IntegrityError("; ".join(f"{r.file}: {r.problem}" for r in bad))
    files = rows.where("row = 'chapter'").groupBy("chapter").count().collect()
    if not files:
        raise FileNotFoundError(f"no chapter files under {path}")
    spans = ch.ranges(rows, recs)
    told = recs.select(F.col("ordinal.file").alias("file")).union(spans.select("ordinal.file")).distinct()
    if void := rows.where("row = 'chapter'").join(told, "file", "left_anti").limit(5).collect():
        raise IntegrityError("; ".join(f"chapter {r.chapter}: no sections; an empty file is not an empty chapter" for r in void))
    if twice := [r.chapter for r in files if r["count"] > 1]:
        raise IntegrityError(f"two files for chapter {twice[0]}")
    covered = sorted({r.chapter for r in files} | {r.chapter for r in recs.select("chapter").distinct().collect()})
    stamp = ch.oldest_currency(rows).first()
    docs = recs.drop("file", "number", "sect_ref", "path", "problem")
    return Crawl("mcl", docs, spans, chapters=covered, kinds=["mcl", "const"], currency=stamp.currency if stamp else None)


def chapter_site(spark: SparkSession, chapters: str | None, kind: str, site: str = "", client: Client | None = None, landing: str | None = None, base_url: str = "") -> Crawl:
    """Whole chapters from the site, fetched into ``landing`` first: one polite client, one file at a
    time. ``chapters`` is a list ("37 38" or "37,38"), all if empty. ``site`` is its address."""
    if not site:
        raise ValueError("a web source needs the address of the site")
    names = [c for c in re.split(r"[\s,]+", chapters or "") if c] or None
    folder = landing or os.path.join(shared_dir(spark).removeprefix("file://").removeprefix("file:"), "landing", kind)
    if client is None:
        raise ValueError("a web source needs a client that says who crawls")
    if kind == "xml":
        got = land_xml(client, f"{site}/documents/mcl/", folder, names)
        files = [*got["fetched"], *got["unchanged"]]
        wanted = files_for(names)[1] if names else None
    else:
        files = [f"chapter-{c}.html" for c in land_html(client, site, folder, names)]
        wanted = None
    if not files:
        raise FileNotFoundError(f"the site lists none of the chapters {chapters}")
    return chapter_folder(spark, [os.path.join(folder, f) for f in sorted(files)], kind, wanted, base_url)


SOURCES: dict[str, Callable[..., Crawl]] = {
    "fixture": json_fixture,
    "mcl-files": lambda spark, path, **kw: chapter_folder(spark, path, "html", **kw),
    "mcl-web": lambda spark, path, **kw: chapter_site(spark, path, "html", **kw),
    "mcl-xml-files": lambda spark, path, **kw: chapter_folder(spark, path, "xml", **kw),
    "mcl-xml-web": lambda spark, path, **kw: chapter_site(spark, path, "xml", **kw),
}


def get_source(spark: SparkSession, kind: str, path: str | None, **options) -> Crawl:
    """A crawl by the kind of its source; web kinds take a list of chapters, or none, as their path."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(SOURCES)}")
    if not path and not kind.endswith("-web"):
        raise ValueError(f"source {kind!r} needs a path")
    return SOURCES[kind](spark, path, **options)


_CHANNEL = "title string, lastBuildDate string, item array<struct<title:string,link:string,guid:string,description:string,pubDate:string>>"
# Fixed value: the sentence that ends every item's description.
BOILERPLATE = r"\s*Please see compilers notes or history at the bottom of the section for details\.?\s*$"


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, each with the build time of its own channel, classified into events."""
    from ..functions.timestamps import by_convention, iso_instant, with_time_candidates

    channels = spark.read.format("xml").schema(_CHANNEL).option("rowTag", "channel").load(path)
    if channels.limit(1).count() == 0:
        raise ValueError("no channel: not an RSS feed")
    utc = channels.select(F.col("lastBuildDate").alias("feed_built_raw"), F.inline("item")).withColumn("_utc", F.lit("UTC"))
    for value, out in (("pubDate", "published"), ("feed_built_raw", "feed_built_at")):
        utc = with_time_candidates(utc, value, "_utc", "_c").withColumn(out, iso_instant(by_convention(F.col("_c")))).drop("_c")
    obj = fd.object_name(F.col("link"), F.col("guid"))
    desc = F.trim(F.regexp_replace(collapse(F.coalesce("description", F.lit(""))), BOILERPLATE, ""))
    name = fd.heading(F.col("title"), obj)
    ev = utc.select(collapse(F.col("title")).alias("raw_title"), obj.alias("object_name"), F.nullif("link", F.lit("")).alias("url"), F.coalesce(name, desc).alias("catchline_hint"),
                    F.when(name.isNull(), fd.status_hint(desc)).alias("status_hint"), "published", "feed_built_at", fd.classify(F.col("title"), obj).alias("e"))
    return ev.select("*", "e.*").drop("e")


def directory_listing(spark: SparkSession, path: str) -> DataFrame:
    """Entries of saved listing pages."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.inline(listing_entries(F.col("value"))))


def covered_by_name(name: str) -> str | None:
    m = re.match(r"(?i)^chapter ([0-9]+[a-z]?)\.xml$", name)
    return m.group(1).upper() if m else None
