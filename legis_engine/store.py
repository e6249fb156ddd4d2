"""The store: immutable folders and numbered commits; adding a commit is what makes a run count.

Documents, current versions, references and the search index are kept in parts, a part being what a
hash of the source and the chapter in the citation says. A run reads and writes only the parts it
touches and names the new folders in its commit; all other parts stay where they are. What never
changes again, closed versions and the change log, is appended in a folder per run.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog
from .functions.citations import sort_key
from .functions.xrefs import extract_xrefs
from .operators import merge as mg
from .operators import search as se
from .sources.loaders import Crawl

SCHEMA_VERSION = 3
PARTS = 64
RANGES = "source string, start_citation string, end_citation string, chapter string, act_citation string, act_name string, note string, status string, active boolean, first_seen string"
ACTS = "year int, number int, title string, effective_date string, url string, affected_citations array<string>"
RUNS = (
    "run_id bigint, source string, started_at string, finished_at string, status string, complete_crawl boolean, scope string, docs_seen bigint, docs_new bigint, "
    "docs_modified bigint, docs_removed bigint, docs_restored bigint, source_currency string, error string"
)
XREFS = "source string, citation string, seq int, kind string, key string, raw string, in_range boolean"
POSTINGS = "term string, source string, citation string, field string, positions array<int>"
STATS = "source string, citation string, tokens bigint"
TABLES = {"documents": mg.DOCUMENTS, "versions": mg.VERSIONS, "changes": mg.CHANGES, "ranges": RANGES, "acts": ACTS, "xrefs": XREFS, "postings": POSTINGS, "doc_stats": STATS}
PARTED = ("documents", "versions", "xrefs", "postings", "doc_stats")
APPENDED = ("versions", "changes")


class Conflict(RuntimeError):
    """Another writer committed since this one read."""


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def part_of(source: Column, citation: Column) -> Column:
    """The part of a record: fixed by its key, so a record never moves; a chapter lies in one part."""
    k = sort_key(citation)
    return F.pmod(F.xxhash64(source, k["n1"], k["l1"]), F.lit(PARTS)).cast("int")


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = CommitLog(spark, folder)
        p = self.pointer()
        if p["schema_version"] != SCHEMA_VERSION:
            raise RuntimeError(f"store has schema version {p['schema_version']}, this code {SCHEMA_VERSION}")

    def _read_pointer(self) -> tuple[int, dict]:
        n, p = self.commits.latest()
        return n, p or {"schema_version": SCHEMA_VERSION, "snapshot": None, "tables": {}, "appended": [], "runs": []}

    def pointer(self) -> dict:
        return self._read_pointer()[1]

    def create(self) -> None:
        """The first commit of an empty store."""
        n, p = self._read_pointer()
        if n == 0:
            self.commits.add(1, p)

    def _at(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.folder}/{a}" for a in sorted(set(paths))])

    def table(self, name: str, current: bool = False, parts: list[int] | None = None) -> DataFrame:
        """A table as of the last commit; ``current``: of versions the current ones only; ``parts``:
        only the records in them."""
        return self._table(self.pointer(), name, current, parts)

    def _table(self, p: dict, name: str, current: bool = False, parts: list[int] | None = None) -> DataFrame:
        held = p["tables"].get(name, {})
        at = [a for k, a in held.items() if parts is None or int(k) in parts]
        if name in APPENDED and not current:
            at += [f"{a}/{name}" for a in p["appended"]]
        return self._at(name, at)

    def part(self, source: str, citation: str) -> list[int]:
        """The part that holds a record, for reads of one record."""
        return [self.spark.range(1).select(part_of(F.lit(source), F.lit(citation)).alias("p")).first().p]

    def runs(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c.split()[0]) for c in RUNS.split(", ")) for r in self.pointer()["runs"]], RUNS)

    def _touched(self, p: dict, crawl: Crawl) -> list[int]:
        """Parts a crawl can change: those of its records and, if it is complete, of what it may find missing."""
        parts = crawl.documents.select(part_of(F.col("source"), F.col("citation")).alias("p"))
        if crawl.complete:
            held = self._table(p, "documents").where(F.col("active") & F.col("source").isin(crawl.kinds))
            if crawl.chapters is not None:
                held = held.where(F.col("chapter").isin(crawl.chapters))
            parts = parts.union(held.select(part_of(F.col("source"), F.col("citation"))))
        return sorted(r.p for r in parts.distinct().collect() if r.p is not None)

    def _write(self, df: DataFrame, name: str, into: str) -> None:
        df.select(*_columns(name)).write.parquet(f"{self.folder}/{into}/{name}")

    def _write_parts(self, df: DataFrame, name: str, into: str, parts: list[int]) -> dict[str, str]:
        """Writes a table by parts; names the folder of every part, so that an empty one is known too."""
        order = ["term"] if name == "postings" else ["source", "citation"]
        placed = df.select(*_columns(name), part_of(F.col("source"), F.col("citation")).alias("part"))
        # A large part is several files: sorted, so that a reader of one key or term skips most of each.
        placed.repartition(F.col("part"), F.pmod(F.xxhash64(*order), F.lit(8))).sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{self.folder}/{into}/{name}")
        there = self.commits.children(f"{into}/{name}")
        return {str(k): f"{into}/{name}/part={k}" for k in parts if f"part={k}" in there}

    def ingest(self, crawl: Crawl, guard: float = 0.9, now: str | None = None) -> dict:
        """One run: merged, written and committed as a whole. A failure leaves the data as it was
        and a failed run in the log, and is raised."""
        now = now or utc_now()
        n, p = self._read_pointer()
        run_id = 1 + max((r["run_id"] for r in p["runs"]), default=0)
        scope = None if crawl.chapters is None else "chapters:" + ",".join(crawl.chapters)
        base = {"run_id": run_id, "source": crawl.name, "started_at": now, "complete_crawl": crawl.complete, "scope": scope, "source_currency": crawl.currency}
        run = mg.Run(run_id, now, crawl.name, crawl.kinds, crawl.complete, crawl.chapters, guard)
        try:
            parts = self._touched(p, crawl)
            # Each document has one current version, its latest, so the merge needs no closed ones.
            m = mg.merge(self._table(p, "documents", parts=parts), self._table(p, "versions", True, parts), crawl.documents, run)
            snap = f"snap={run_id:08d}-{uuid.uuid4().hex[:8]}"
            news = f"run={run_id:08d}-{uuid.uuid4().hex[:8]}"
            tables = {k: dict(v) for k, v in p["tables"].items()}

            def put(df: DataFrame, name: str) -> DataFrame:
                made = self._write_parts(df, name, snap, parts)
                tables[name] = {k: a for k, a in tables.get(name, {}).items() if int(k) not in parts} | made
                return self._at(name, list(made.values()))

            docs = put(m.documents, "documents")
            current = put(m.versions.where("is_current"), "versions")
            self._write(m.versions.where("not is_current"), "versions", news)
            self._write(m.changes, "changes", news)
            changes = self._at("changes", [f"{news}/changes"]).where("variant = ''")
            key = ["source", "citation"]
            # References and index entries of changed documents only; the others keep theirs.
            changed = changes.select(*key, "change_type")
            texts = current.where("variant = ''").join(changed.where("change_type <> 'removed'").select(*key), key)
            whole = texts.select(F.struct(*key).alias("id"), F.col("citation").alias("self"), F.concat_ws("\n", "text", "history_note", "compilers_notes").alias("t"))
            refs = extract_xrefs(whole, "id", "t", "self").select("id.source", "id.citation", "seq", "kind", "key", "raw", "in_range")
            renewed = changed.where("change_type <> 'removed'").select(*key)
            put(self._table(p, "xrefs", parts=parts).join(renewed, key, "left_anti").unionByName(refs), "xrefs")
            fields = texts.select(F.struct(*key).alias("id"), "citation", "catchline", "text")
            split = lambda df: df.select("*", "id.source", "id.citation").drop("id")
            gone = changed.select(*key).distinct()
            put(self._table(p, "postings", parts=parts).join(gone, key, "left_anti").unionByName(split(se.postings(fields, "id", list(se.WEIGHTS))).select(*_columns("postings"))), "postings")
            put(self._table(p, "doc_stats", parts=parts).join(gone, key, "left_anti").unionByName(split(se.doc_stats(fields, "id", list(se.WEIGHTS))).select(*_columns("doc_stats"))), "doc_stats")
            for name, df in (
                ("ranges", None if crawl.ranges is None else mg.merge_ranges(self._table(p, "ranges"), crawl.ranges, run)),
                ("acts", None if crawl.acts is None else mg.merge_acts(self._table(p, "acts"), crawl.acts)),
            ):
                if df is not None:
                    self._write(df, name, snap)
                    tables[name] = {"0": f"{snap}/{name}"}
            del docs
        except Exception as e:
            failed = base | {"finished_at": utc_now(), "status": "failed", "error": str(e)[:500]}
            while True:
                k, q = self._read_pointer()
                if self.commits.add(k + 1, q | {"runs": [*q["runs"], failed]}):
                    break
            raise
        done = base | {k: v for k, v in m.report.items() if k.startswith("docs_")} | {"finished_at": now, "status": "ok"}
        if not self.commits.add(n + 1, p | {"snapshot": snap, "tables": tables, "appended": [*p["appended"], news], "runs": [*p["runs"], done]}):
            raise Conflict("the store changed while this run was merging")
        return m.report

    def collect_garbage(self) -> list[str]:
        """Folders the last commit does not name (old parts, runs that failed); removed."""
        p = self.pointer()
        live = {a.split("/")[0] for t in p["tables"].values() for a in t.values()} | set(p["appended"])
        dead = [d for d in self.commits.children("") if d.startswith(("snap=", "run=")) and d not in live]
        for d in dead:
            self.commits.remove(d)
        return dead
