"""Feed-driven refresh: log new events, plan the chapters to read again, ingest just those.

A plan stays pending in the log until its ingest has succeeded, so a failed refresh is retried. Log
and plan move by numbered commits, so two polls at once neither lose nor repeat anything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commits import CommitLog
from .operators.feed import record, resolve_chapters, summary_by_chapter, summary_by_kind, summary_lists, work_lists
from .sources.loaders import get_source
from .store import Store

EVENT_COLUMNS = ["raw_title", "object_name", "url", "catchline_hint", "status_hint", "published", "feed_built_at", "kind", "citation", "act_citation", "variant"]


def _listed(lists: DataFrame, names: tuple[str, ...]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in names}
    for r in lists.orderBy("list", "value").collect():
        out[r["list"]].append(r.value)
    return out


def summarize(events: DataFrame) -> dict:
    """What a feed says: a build's events are a bounded list, so the answer is a small dictionary."""
    chapters = summary_by_chapter(events).orderBy(F.desc("n_events"), "chapter").collect()
    return {
        "built_at": events.agg(F.max("feed_built_at")).first()[0], "items": events.count(), "by_kind": {r.kind: r.n_events for r in summary_by_kind(events).collect()},
        "chapters_touched": {r.chapter: r.n_events for r in chapters},
        **_listed(summary_lists(events), ("variant_nodes", "act_level_events", "acts_touched", "unrecognized_titles")),
    }


class Feed:
    def __init__(self, store: Store):
        self.store = store
        self.folder = f"{store.folder}/feed"
        self.commits = CommitLog(store.spark, self.folder)

    def _plans(self) -> tuple[int, dict]:
        n, p = self.commits.latest()
        return n, p or {"batches": [], "pending": []}

    def _log(self, plans: dict, like: DataFrame) -> DataFrame:
        paths = [f"{self.folder}/{b}" for b in plans["batches"]]
        return self.store.spark.read.schema(like.schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], like.schema)

    def log(self, like: DataFrame) -> DataFrame:
        return self._log(self._plans()[1], like)

    def take(self, events: DataFrame) -> dict:
        """Logs the new events and adds their chapters to the pending plan."""
        events = events.select(*EVENT_COLUMNS)
        while True:
            n, plans = self._plans()
            name = f"batch={uuid.uuid4().hex}"
            record(self._log(plans, events), events).write.parquet(f"{self.folder}/{name}")
            fresh = self.store.spark.read.schema(events.schema).parquet(f"{self.folder}/{name}")
            rows = resolve_chapters(fresh, self.store.table("documents"), self.store.table("ranges")).collect()
            chapters = sorted({r.chapter for r in rows if r.mapped and r.chapter})
            if self.commits.add(n + 1, {"batches": [*plans["batches"], name], "pending": sorted({*plans["pending"], *chapters})}):
                break
            self.commits.remove(name)  # somebody else logged first: what is new has to be found again
        return _listed(work_lists(fresh), ("refetch_sections", "refetch_objects", "recrawl_acts", "unrecognized")) | {
            "new_events": fresh.count(), "by_kind": {r.kind: r.n_events for r in summary_by_kind(fresh).collect()},
            "chapters_touched": {r.chapter: r.n_events for r in summary_by_chapter(fresh).collect()},
            "refresh_chapters": chapters, "unmapped_acts": sorted(r.act_citation for r in rows if not r.mapped),
        }

    def refresh(self, kind: str, path: str | None = None, guard: float = 0.9, now: str | None = None, **options) -> dict | None:
        """Ingests the pending chapters, from a folder or (the web kinds) from the site; nothing
        pending, nothing done."""
        done = self._plans()[1]["pending"]
        if not done:
            return None
        if kind.endswith("-web"):
            path = " ".join(done)
        else:
            options["wanted"] = done
        report = self.store.ingest(get_source(self.store.spark, kind, path, **options), guard, now)
        while True:
            # What was added to the plan during the ingest stays for the next one.
            n, plans = self._plans()
            if self.commits.add(n + 1, plans | {"pending": [c for c in plans["pending"] if c not in done]}):
                return report
