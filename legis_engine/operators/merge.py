"""The guarded snapshot merge: a crawl against the store, giving documents, versions and changes.

Pure: it reads DataFrames and returns DataFrames; ``store.Store`` writes them all or none.
Records with one key within a run count in their order, as if merged one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import SPACE, citation_struct, normalize_citation
from ..session import materialize

KEY = ["source", "citation", "variant"]
META = ["kind", "chapter", "act_citation", "act_name", "url"]
BODY = ["catchline", "text", "history_note", "compilers_notes", "status", "effective_date"]

# ``ordinal`` may be of any type that orders the records of a run.
DOC_SCHEMA = (
    "ordinal bigint, source string, citation string, variant string, kind string, chapter string, act_citation string, act_name string, "
    "url string, catchline string, text string, history_note string, compilers_notes string, status string, effective_date string"
)
DOCUMENTS = "source string, citation string, variant string, kind string, chapter string, act_citation string, act_name string, url string, active boolean, first_seen string, removed_at string"
VERSIONS = (
    "source string, citation string, variant string, version_no int, run_id bigint, catchline string, text string, history_note string, "
    "compilers_notes string, status string, effective_date string, content_hash string, first_seen string, last_seen string, is_current boolean"
)
CHANGES = "run_id bigint, source string, citation string, variant string, version_no int, change_type string, at string"


class GuardError(RuntimeError):
    """A complete crawl saw too few of the documents that were there."""


class IntegrityError(RuntimeError):
    """Records that must not enter the store."""


@dataclass
class Run:
    run_id: int
    now: str
    name: str = "mcl"
    kinds: list[str] = field(default_factory=list)
    complete: bool = True
    chapters: list[str] | None = None
    guard: float = 0.9


@dataclass
class Merged:
    documents: DataFrame
    versions: DataFrame
    changes: DataFrame
    report: dict


def _squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def _quoted(c: Column) -> Column:
    """A JSON string literal of the text."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def content_hash(catchline: Column, text: Column, history: Column, notes: Column, status: Column) -> Column:
    """Digest of what a version says; dates, links and act names are not part of it."""
    parts = [_quoted(_squash(c)) for c in (catchline, text, history, notes)] + [_quoted(F.coalesce(status, F.lit("")))]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256)


def violations(docs: DataFrame, run: Run) -> DataFrame:
    """``citation, problem`` of records that break the contract of the store."""
    kinds = run.kinds or [run.name]
    c = citation_struct(F.col("citation"))
    bad = (
        F.when(c.isNull() | (c["canonical"] != F.col("citation")), "citation is not canonical")
        .when(c["source"] != F.col("source"), "citation belongs to another source")
        .when(~F.col("source").isin(kinds), "source was not declared")
    )
    if run.chapters is not None:
        bad = bad.when(F.coalesce(~F.col("chapter").isin(run.chapters), F.lit(True)), "chapter is out of the declared scope")
    return docs.select("citation", bad.alias("problem")).where(F.col("problem").isNotNull())


def merge(documents: DataFrame, versions: DataFrame, incoming: DataFrame, run: Run) -> Merged:
    """The store after ``incoming`` (DOC_SCHEMA), the run's changes and its counters.

    Raises before anything is computed further if records are invalid, or if a complete crawl saw
    fewer than ``guard`` of the active documents in scope.
    """
    kinds = run.kinds or [run.name]
    bad = violations(incoming, run).limit(5).collect()
    if bad:
        raise IntegrityError("; ".join(f"{r.citation}: {r.problem}" for r in bad))
    in_scope = F.col("source").isin(kinds)
    if run.chapters is not None:
        in_scope = in_scope & F.coalesce(F.col("chapter").isin(run.chapters), F.lit(False))
    seen = incoming.count()
    if run.complete:
        before = documents.where(F.col("active") & in_scope).count()
        if before and seen < run.guard * before:
            raise GuardError(f"saw {seen} of {before} documents")

    hashed = incoming.withColumn("variant", F.coalesce("variant", F.lit(""))).withColumn(
        "content_hash", content_hash(*[F.col(c) for c in BODY[:5]])
    )
    # What the store holds of a key, in one row.
    per = versions.groupBy(*KEY).agg(F.max("version_no").alias("_last_no"), F.max(F.when(F.col("is_current"), F.struct("version_no", "content_hash"))).alias("_cur"))
    state = documents.select(*KEY, F.col("active").alias("_was")).join(per, KEY, "full_outer")
    # A key's records in their order: each sees the hash its predecessor left.
    w = Window.partitionBy(*KEY).orderBy("ordinal")
    joined = hashed.join(state, KEY, "left")
    step = joined.withColumns({"_first": F.row_number().over(w) == 1, "_prev": F.coalesce(F.lag("content_hash").over(w), F.col("_cur.content_hash"))})
    step = step.withColumns({
        "_new_version": F.col("_prev").isNull() | (F.col("_prev") != F.col("content_hash")),
        "_gone": F.col("_first") & (F.coalesce(F.col("_was"), F.lit(True)) == F.lit(False)),
    })
    step = step.withColumns({
        "version_no": (F.coalesce("_last_no", F.lit(0)) + F.sum(F.col("_new_version").cast("int")).over(w)).cast("int"),
        "change_type": F.when(F.col("_prev").isNull(), "new").when(F.col("_gone"), "restored").when(F.col("_new_version"), "modified"),
        "_last_of_key": F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ordinal"))) == 1,
    })
    # Written once: documents, versions, changes and counters are all read from it. Texts go along
    # only where they are a new version.
    body = [F.when(F.col("_new_version"), F.col(c)).alias(c) for c in BODY]
    step = materialize(step.select(*KEY, *META, *body, "content_hash", "version_no", "change_type", "_first", "_new_version", "_last_of_key"), "merge_step")

    # Versions: the old ones touched or closed, the new ones of this run.
    touched = step.groupBy(*KEY).agg(
        F.lit(True).alias("_seen"), F.max("_new_version").alias("_any_new"), F.max(F.when(F.col("_first"), F.col("_new_version"))).alias("_closed"), F.max("version_no").alias("_latest")
    )
    old = versions.join(touched, KEY, "left").select(
        *KEY, "version_no", "run_id", *BODY, "content_hash", "first_seen",
        F.when(F.col("is_current") & F.col("_seen") & ~F.col("_closed"), run.now).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.col("is_current") & ~F.coalesce("_any_new", F.lit(False))).alias("is_current"),
    )
    new = step.where("_new_version").join(touched.select(*KEY, "_latest"), KEY).select(
        *KEY, "version_no", F.lit(run.run_id).cast("bigint").alias("run_id"), *BODY, "content_hash",
        F.lit(run.now).alias("first_seen"), F.lit(run.now).alias("last_seen"), (F.col("version_no") == F.col("_latest")).alias("is_current"),
    )

    # Documents: overwritten by the last record of their key, added, or removed.
    latest = step.where("_last_of_key").select(*KEY, *[F.col(c).alias(f"_{c}") for c in META], F.lit(True).alias("_hit"))
    merged = documents.join(latest, KEY, "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    removed_now = F.lit(run.complete) & F.coalesce(F.col("active"), F.lit(False)) & ~hit & in_scope
    after = merged.withColumn("_gone_now", removed_now).select(
        *KEY, *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in META],
        F.when(hit, True).when(F.col("_gone_now"), False).otherwise(F.col("active")).alias("active"),
        F.coalesce("first_seen", F.lit(run.now)).alias("first_seen"),
        F.when(hit, None).when(F.col("_gone_now"), run.now).otherwise(F.col("removed_at")).alias("removed_at"),
        "_gone_now",
    )
    gone = after.where("_gone_now").join(per.select(*KEY, F.col("_cur.version_no").alias("version_no")), KEY, "left")
    row = [F.lit(run.run_id).cast("bigint").alias("run_id"), *KEY, "version_no"]
    changes = step.where(F.col("change_type").isNotNull()).select(*row, "change_type", F.lit(run.now).alias("at")).unionByName(
        gone.select(*row, F.lit("removed").alias("change_type"), F.lit(run.now).alias("at"))
    )
    changes = materialize(changes, "merge_changes")
    counts = {r["change_type"]: r["count"] for r in changes.groupBy("change_type").count().collect()}
    report = {"run_id": run.run_id, "source": run.name, "docs_seen": seen} | {
        f"docs_{k}": counts.get(k, 0) for k in ("new", "modified", "removed", "restored")
    }
    return Merged(after.drop("_gone_now"), old.unionByName(new), changes, report)


def last_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key by ``ordinal``; rows without that column count in the order of their values."""
    rest = [c for c in rows.columns if c not in key]
    first = [c for c in rest if c == "ordinal"]
    best = rows.groupBy(*key).agg(F.max(F.struct(*first, *[c for c in rest if c != "ordinal"])).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest if c != "ordinal"])


def check_ranges(incoming: DataFrame) -> None:
    """Raises if an end of a range is no canonical citation of the range's own source."""
    ends = incoming.select("source", F.explode(F.array("start_citation", "end_citation")).alias("c"))
    read = citation_struct(F.col("c"))
    sound = F.coalesce((read["canonical"] == F.col("c")) & (read["source"] == F.col("source")), F.lit(False))
    if bad := ends.where(~sound).limit(5).collect():
        raise IntegrityError("; ".join(f"range with the citation {r.c!r}" for r in bad))


def merge_ranges(ranges: DataFrame, incoming: DataFrame, run: Run) -> DataFrame:
    """Ranges upserted by (source, start, end), the last of repeated ones: first_seen kept, unseen
    ones of a complete run in scope deactivated. Citations that are not canonical stop the run."""
    check_ranges(incoming)
    key = ["source", "start_citation", "end_citation"]
    rest = ["chapter", "act_citation", "act_name", "note", "status"]
    seen = last_of(incoming.select(*key, *rest, *[c for c in incoming.columns if c == "ordinal"]), key).select(*key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_hit"))
    joined = ranges.join(seen, key, "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    scope = F.col("source") == run.name
    if run.chapters is not None:
        scope = scope & F.coalesce(F.col("chapter").isin(run.chapters), F.lit(False))
    return joined.select(
        *key, *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest],
        F.when(hit, True).when(F.lit(run.complete) & scope, False).otherwise(F.col("active")).alias("active"),
        F.coalesce("first_seen", F.lit(run.now)).alias("first_seen"),
    )


def merge_acts(acts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Acts upserted by (year, number), the last of repeated ones; the incoming row and its targets
    replace the stored ones. Targets are kept in canonical form, each once; one that is no citation
    stops the run."""
    key = ["year", "number"]
    told = incoming.select(*key, F.explode("affected_citations").alias("c"))
    if bad := told.where(normalize_citation(F.col("c")).isNull()).limit(5).collect():
        raise IntegrityError("; ".join(f"{r.year} PA {r.number} with the citation {r.c!r}" for r in bad))
    targets = F.array_distinct(F.transform(F.coalesce("affected_citations", F.array().cast("array<string>")), normalize_citation))
    fresh = last_of(incoming, key).withColumn("affected_citations", targets).select(*acts.columns)
    return acts.join(fresh.select(*key), key, "left_anti").unionByName(fresh)
