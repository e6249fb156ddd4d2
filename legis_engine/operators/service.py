"""The read queries over the store's tables, each a DataFrame for all keys or for one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import sort_key

# Fixed value: the standing notice that goes with every answer carrying text.
NOTICE = "Text is as observed in the source on the dates shown; it is not an official copy and not legal advice."
LIMITS = {"search": (10, 1, 50), "outline": (200, 1, 500), "references": (100, 1, 500), "changes": (100, 1, 500)}


def clamp(kind: str, value: int | None) -> int:
    default, low, high = LIMITS[kind]
    return default if value is None else max(low, min(int(value), high))


def check_date(text: str) -> str:
    """An existing calendar date as yyyy-MM-dd, or ValueError."""
    from datetime import date

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text or ""):
        raise ValueError(f"{text!r} is not a date (yyyy-mm-dd)")
    return date.fromisoformat(text).isoformat()


def as_of(versions: DataFrame, key: list[str], order: list[str], on: str | Column) -> DataFrame:
    """Of each key the latest version first seen on or before a date, and whether a later one was
    seen since. Keys without one by then are left out."""
    at = F.lit(on) if isinstance(on, str) else on
    rows = versions.withColumn("_day", F.substring("first_seen", 1, 10))
    w = Window.partitionBy(*key)
    last = rows.withColumn("_newest", F.max(F.struct(*order)).over(w)).where(F.col("_day") <= at)
    best = last.withColumn("_rn", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where("_rn = 1")
    return best.withColumn("superseded", F.struct(*order) < F.col("_newest")).drop("_day", "_newest", "_rn")


def other_forms(documents: DataFrame) -> DataFrame:
    """Active variant forms of each citation, ordered: ``source, citation, n_forms, forms``."""
    v = documents.where(F.col("active") & (F.coalesce("variant", F.lit("")) != ""))
    return v.groupBy("source", "citation").agg(
        F.count(F.lit(1)).alias("n_forms"), F.array_join(F.sort_array(F.collect_list("variant")), ",").alias("forms")
    )


def run_states(runs: DataFrame) -> DataFrame:
    """One row per run: its outcome if it has one, else running."""
    s = F.lower(F.trim("status"))
    rank = F.when(s == "ok", 3).when(s == "failed", 2).otherwise(1)
    return runs.groupBy("run_id").agg(
        *[F.max_by(c, F.struct(rank, F.coalesce("finished_at", F.lit("")))).alias(c) for c in ("source", "started_at", "finished_at", "complete_crawl", "scope", "source_currency", "error")],
        F.max_by(s, F.struct(rank, F.coalesce("finished_at", F.lit("")))).alias("status"),
    )


def provenance(states: DataFrame) -> DataFrame:
    """``source, run_id, source_currency`` of each source's last successful run."""
    ok = states.where("status = 'ok'")
    last = F.struct("started_at", "run_id")
    return ok.groupBy("source").agg(F.max_by("run_id", last).alias("run_id"), F.max_by("source_currency", last).alias("source_currency"))


def outline(documents: DataFrame) -> DataFrame:
    """Active ordinary sections with their place in their chapter's natural order.

    A chapter is ranked in stretches of a hundred section numbers, which bounds every window group;
    the stretches' sizes give what comes before each.
    """
    d = documents.where(F.col("active") & (F.coalesce("variant", F.lit("")) == "")).withColumn("_k", sort_key(F.col("citation")))
    d = d.withColumn("_s", F.struct("_k.n1", "_k.l1", F.floor(F.col("_k.n2") / 100).alias("n2")))
    group = ["source", "chapter"]
    inner = d.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_s").orderBy("_k", "citation")))
    before = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*group, "_s").count()
    offsets = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in (*group, "_s")], F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    same = F.col("source").eqNullSafe(F.col("_g_source")) & F.col("chapter").eqNullSafe(F.col("_g_chapter")) & F.col("_s").eqNullSafe(F.col("_g__s"))
    return inner.join(offsets, same).withColumn("place", F.col("_before") + F.col("_in")).drop("_k", "_s", "_in", "_before", "_g_source", "_g_chapter", "_g__s")


def outline_page(documents: DataFrame, chapter: str, source: str = "mcl", offset: int = 0, limit: int | None = None) -> DataFrame:
    """One page of a chapter; the plan keeps offset + limit rows per task, not the chapter."""
    from .search import normalise_chapter

    d = documents.where(
        F.col("active") & (F.coalesce("variant", F.lit("")) == "") & (F.col("chapter") == normalise_chapter(chapter)) & (F.col("source") == source)
    ).withColumn("_k", sort_key(F.col("citation")))
    return d.orderBy("_k", "citation").offset(max(0, offset)).limit(clamp("outline", limit)).drop("_k")


def cites(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """References (``source, key``) with ``in_database`` and the target's fields; unresolved kept.
    Popular targets are spread like everywhere else."""
    from .skew import skew_left_join

    live = documents.where(F.col("active") & (F.coalesce("variant", F.lit("")) == "")).select(
        F.col("source").alias("kind"), F.col("citation").alias("key"), F.col("doc_id").alias("target_id")
    )
    return skew_left_join(refs, live, ["kind", "key"]).withColumn("in_database", F.col("target_id").isNotNull())


def cited_by(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """``key, citing`` from active ordinary documents; the target need not exist."""
    live = documents.where(F.col("active") & (F.coalesce("variant", F.lit("")) == "")).select(F.col("doc_id").alias("from_id"), F.col("citation").alias("citing"))
    return refs.join(live, "from_id")


def range_hits(refs: DataFrame, ranges: DataFrame, key_col: str = "key") -> DataFrame:
    """References with the ranges they fall in, by natural order of citations; references in none
    stay, with null.

    A range may cross chapters: it is spread over the chapter numbers it touches, at most the ten
    thousand there can be, and joined on them.
    """
    left = refs.withColumn("_k", sort_key(F.col(key_col)))
    right = ranges.withColumns({"_lo": sort_key(F.col("start_citation")), "_hi": sort_key(F.col("end_citation"))})
    inside = (F.col("_lo") <= F.col("_k")) & (F.col("_k") <= F.col("_hi"))
    spread = right.where(F.col("_lo.n1") <= F.col("_hi.n1")).withColumn("_ch", F.explode(F.sequence("_lo.n1", "_hi.n1")))
    return left.join(spread, (F.col("_k.n1") == F.col("_ch")) & inside, "left").drop("_k", "_lo", "_hi", "_ch")


def list_changes(changes: DataFrame, since: str, source: str | None = None, change_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Changes on or after a day, newest first, ties by document id."""
    if change_type and change_type not in ("new", "modified", "removed", "restored"):
        raise ValueError(f"unknown change type {change_type!r}")
    d = changes.where(F.substring("at", 1, 10) >= check_date(since))
    if source:
        d = d.where(F.col("source") == source)
    if change_type:
        d = d.where(F.col("change_type") == change_type)
    return d.orderBy(F.desc("at"), F.asc("document_id"), F.asc("change_type")).limit(clamp("changes", limit))


def public_act(acts: DataFrame, refs: DataFrame, documents: DataFrame) -> DataFrame:
    """Each act with the sections that name it, one row per section; an act that none names has one
    row without a section. An act half the corpus cites is as many rows, never one list."""
    one = acts.groupBy("act_citation").agg(F.min("title").alias("title"), F.min("effective_date").alias("effective_date"))
    targets = refs.join(documents.select(F.col("doc_id").alias("from_id"), "citation"), "from_id").select(F.col("key").alias("act_citation"), "citation").distinct()
    return one.join(targets, "act_citation", "left").select("act_citation", "title", "effective_date", "citation")


def data_status(documents: DataFrame, states: DataFrame) -> DataFrame:
    """Per source of runs: counts of active, removed and variant documents, last good and last full
    run, last status and its error if it failed.

    ``documents.source`` must be the source of the run that made the document's current version: one
    crawl brings documents of several kinds.
    """
    docs = documents.groupBy("source").agg(
        F.sum((F.col("active") & (F.col("variant") == "")).cast("bigint")).alias("active_documents"),
        F.sum((~F.col("active") & (F.col("variant") == "")).cast("bigint")).alias("removed_documents"),
        F.sum((F.col("active") & (F.col("variant") != "")).cast("bigint")).alias("extra_forms_listed"),
    )
    ok = F.col("status") == "ok"
    full = ok & F.col("complete_crawl") & F.col("scope").isNull()
    when = F.struct("started_at", "run_id")
    runs = states.groupBy("source").agg(
        F.max_by("finished_at", F.when(ok, when)).alias("last_successful_run"),
        F.max_by("source_currency", F.when(ok, when)).alias("source_currency"),
        F.max_by("finished_at", F.when(full, when)).alias("last_full_crawl"),
        F.max_by("status", when).alias("last_run_status"),
        F.max_by("error", when).alias("_error"),
    )
    return docs.join(runs, "source", "full_outer").select(
        "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("active_documents", "removed_documents", "extra_forms_listed")],
        "last_successful_run", "source_currency", "last_full_crawl", "last_run_status", F.when(F.col("last_run_status") == "failed", F.col("_error")).alias("last_run_error"),
    )
