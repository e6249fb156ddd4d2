"""The seven read queries as plain functions over a store, with answers as dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.citations import citation_struct, normalize_act, sort_key
from .functions.history import parse_history
from .operators import search as se
from .operators import service as sv
from .store import Store


class NotFound(LookupError):
    pass


class Service:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _cite(self, text: str):
        r = self.spark.range(1).select(citation_struct(F.lit(text)).alias("c")).first().c
        if r is None:
            raise ValueError(f"{text!r} is not a recognised citation")
        return r.source, r.canonical

    def _held(self):
        d, v = self.store.table("documents"), self.store.table("versions", current=True)
        return d.join(v.drop("first_seen"), ["source", "citation", "variant"])

    def _range_note(self, source: str, citation: str):
        one = self.spark.createDataFrame([(citation,)], "key string")
        return sv.range_hits(one, self.store.table("ranges").where(F.col("active") & (F.col("source") == source))).where("start_citation is not null").first()

    def get_document(self, citation: str, as_of: str | None = None) -> dict:
        """One document, now or as observed by a day (removals do not matter then)."""
        source, canon = self._cite(citation)
        key = (F.col("source") == source) & (F.col("citation") == canon)
        part = self.store.part(source, canon)
        doc = self.store.table("documents", parts=part).where(key & (F.col("variant") == "")).first()
        if doc is None:
            hit = self._range_note(source, canon)
            raise NotFound(f"{canon} has no text of its own: {hit.note}" if hit else f"{canon} is not in the database")
        versions = self.store.table("versions", current=as_of is None, parts=part).where(key & (F.col("variant") == ""))
        out = {"citation": canon, "source": source, "chapter": doc.chapter, "act_citation": doc.act_citation, "act_name": doc.act_name, "in_source_currently": doc.active, "notice": sv.NOTICE}
        if not doc.active:
            out["removed_from_source_at"] = doc.removed_at
        forms = self.store.table("documents", parts=part).where(key & (F.col("variant") != "") & F.col("active"))
        listed = forms.select("source", "citation", "variant", "url").join(self.store.table("versions", current=True, parts=part).where(key), ["source", "citation", "variant"]).orderBy("variant").collect()
        if listed:
            out["other_forms"] = [{"variant": r.variant, "effective_date": r.effective_date, "catchline": r.catchline, "text": r.text, "history_note": r.history_note, "compilers_notes": r.compilers_notes,
                                   "source_url": r.url, "caution": "not the ordinary form of this section"} for r in listed]
        if as_of is None:
            v = versions.where("is_current").first()
            superseded = False
        else:
            v = sv.as_of(versions, ["source", "citation"], ["first_seen", "version_no"], sv.check_date(as_of)).first()
            superseded = bool(v and v.superseded)
            out["as_of"] = as_of
            if v is None:
                return out | {"text": None, "warning": f"first observed on {versions.agg(F.min('first_seen')).first()[0]}"}
        if v is None:
            raise NotFound(f"{canon} has no stored text")
        h = self.spark.createDataFrame([(v.history_note,)], "h string").select(F.inline(parse_history(F.col("h")))).drop("seq").collect()
        run = sv.provenance(self.store.runs().where("status = 'ok'")).join(self.store.runs().where(F.col("run_id") == v.run_id).select("source"), "source").first()
        out |= {
            "catchline": v.catchline, "text": v.text, "history_note": v.history_note, "history_entries": [r.asDict() for r in h], "compilers_notes": v.compilers_notes,
            "status": v.status, "effective_date": v.effective_date, "as_of": as_of or v.last_seen,
            "provenance": {"source_url": doc.url, "last_confirmed": v.last_seen, "version_first_observed": v.first_seen, "source_currency": run.source_currency if run else None, "notice": sv.NOTICE},
        }
        if superseded:
            out["superseded_by_later_version_observed"] = True
        return out

    def search(self, query: str, source: str | None = None, chapter: str | None = None, include_repealed: bool = False, limit: int | None = None) -> dict:
        ident = F.struct("source", "citation").alias("doc_id")
        docs = self._held().select("*", ident)
        index, stats = (self.store.table(t).select("*", ident).drop("source", "citation") for t in ("postings", "doc_stats"))
        hits = se.search(docs, query, "doc_id", source, chapter, include_repealed, sv.clamp("search", limit), index=index, stats=stats).collect()
        shown = [h.citation for h in hits]
        current = self.store.table("versions", current=True).where((F.col("variant") == "") & F.col("citation").isin(shown or [""]))
        seen = {(r.source, r.citation): r.last_seen for r in current.collect()}
        return {"query": query, "count": len(hits), "notice": sv.NOTICE, "results": [
            {"citation": r.citation, "source": r.source, "chapter": r.chapter, "catchline": r.catchline, "status": r.status, "snippet": r.snippet, "source_url": r.url, "last_confirmed": seen.get((r.source, r.citation))} for r in hits
        ]}

    def get_chapter_outline(self, chapter: str, source: str = "mcl", offset: int = 0, limit: int | None = None) -> dict:
        held = self._held()
        page = sv.outline_page(held, chapter, source, offset, limit).select("citation", "catchline", "status", "act_citation", "act_name").collect()
        name = se.normalise_chapter(chapter)
        total = held.where(F.col("active") & (F.col("variant") == "") & (F.col("chapter") == name) & (F.col("source") == source)).count()
        return {"chapter": name, "source": source, "total": total, "offset": max(0, offset), "sections": [r.asDict() for r in page], "notice": sv.NOTICE}

    def get_cross_references(self, citation: str, direction: str = "cites", limit: int | None = None) -> dict:
        source, canon = self._cite(citation)
        docs = self._held().where(F.col("active") & (F.col("variant") == ""))
        x = self.store.table("xrefs")
        n = sv.clamp("references", limit)
        if direction == "cites":
            if docs.where((F.col("source") == source) & (F.col("citation") == canon)).first() is None:
                raise NotFound(f"{canon} is not in the database")
            own = self.store.table("xrefs", parts=self.store.part(source, canon)).where((F.col("source") == source) & (F.col("citation") == canon)).select("seq", "kind", "key", "raw", "in_range")
            found = own.join(docs.select(F.col("source").alias("kind"), F.col("citation").alias("key"), "catchline"), ["kind", "key"], "left").orderBy("seq").limit(n).collect()
            # The ranges of all references that lead nowhere, in one query.
            lost = sorted({r.key for r in found if r.catchline is None and r.kind == "mcl"})
            hits = {}
            if lost:
                told = sv.range_hits(self.spark.createDataFrame([(k,) for k in lost], "key string"), self.store.table("ranges").where(F.col("active") & (F.col("source") == "mcl")))
                hits = {h.key: h for h in told.where("start_citation is not null").orderBy(F.desc("start_citation")).collect()}
            refs = []
            for r in found:
                one = {"kind": r.kind, "citation": r.key, "raw_text": r.raw, "in_range_endpoint": r.in_range, "in_database": r.catchline is not None, "catchline": r.catchline}
                if r.catchline is None and r.kind == "mcl" and (hit := hits.get(r.key)):
                    one["known_repealed_range"] = {"range": f"{hit.start_citation} - {hit.end_citation}", "status": hit.status, "compilers_line": hit.note, "act_citation": hit.act_citation, "act_name": hit.act_name}
                refs.append(one)
        elif direction == "cited_by":
            found = x.where(F.col("key") == canon).join(docs.select("source", "citation", "catchline"), ["source", "citation"]).orderBy("source", sort_key(F.col("citation")), "seq").limit(n).collect()
            refs = [{"citation": r.citation, "source": r.source, "catchline": r.catchline, "raw_text": r.raw, "in_range_endpoint": r.in_range} for r in found]
        else:
            raise ValueError("direction is cites or cited_by")
        return {"citation": canon, "direction": direction, "count": len(refs), "references": refs, "note": "found in the text by pattern", "notice": sv.NOTICE}

    def list_changes(self, since: str, source: str | None = None, change_type: str | None = None, limit: int | None = None) -> dict:
        c = self.store.table("changes").withColumn("document_id", F.struct("source", "citation", "variant"))
        rows = sv.list_changes(c, since, source, change_type, limit)
        cat = self.store.table("versions", current=True).select("source", "citation", "variant", "catchline")
        out = rows.join(cat, ["source", "citation", "variant"], "left").orderBy(F.desc("at"), "document_id").collect()
        first = self.store.runs().where("status = 'ok'").agg(F.min("started_at")).first()[0]
        return {"since": since, "count": len(out), "note": f"changes are as observed; observation began {first}",
                "changes": [{"at": r["at"], "change_type": r.change_type, "citation": r.citation, "variant": r.variant, "source": r.source, "catchline": r.catchline} for r in out]}

    def lookup_public_act(self, act: str) -> dict:
        name = self.spark.range(1).select(normalize_act(F.lit(act))).first()[0]
        y, n = (name or "0 PA 0").split(" PA ")
        r = self.store.table("acts").where((F.col("year") == int(y)) & (F.col("number") == int(n))).first()
        if r is None:
            raise NotFound(f"{act} is not in the database")
        cites = self.spark.createDataFrame([(c,) for c in r.affected_citations or []], "c string").distinct().orderBy(sort_key(F.col("c"))).collect()
        return {"public_act": name, "title": r.title, "effective_date": r.effective_date, "source_url": r.url, "affected_citations": [c.c for c in cites], "notice": sv.NOTICE}

    def data_status(self) -> dict:
        runs = self.store.runs()
        made = self.store.table("versions", current=True).select("source", "citation", "variant", "run_id").join(F.broadcast(runs.select("run_id", F.col("source").alias("crawl"))), "run_id")
        docs = self.store.table("documents").join(made, ["source", "citation", "variant"]).withColumn("source", F.col("crawl"))
        rows = sv.data_status(docs, runs).orderBy("source").collect()
        return {"sources": [r.asDict() for r in rows], "notice": sv.NOTICE}
