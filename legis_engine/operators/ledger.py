"""Processing only new or changed records: a work-item ledger.

An item (source, name) is ``pending`` once a listing shows it new or changed, ``leased`` while a
run works on it and ``done`` when that run succeeds. Leases of runs that fail or never finish
expire and the item is pending again. Each lease carries a fencing token that rises with the
runs of a source; a write whose token is not the item's current one is stale and rejected. A
run's output path is a function of source and token, so a retry replaces its own output.

``ledger`` and ``replay`` take a run log and its listings through these moves, item by item, in one
pass. ``WorkLedger`` keeps the same ledger on shared storage and moves it one run at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..commits import CommitLog
from ..functions.timestamps import by_convention, with_time_candidates

PENDING, LEASED, DONE = "pending", "leased", "done"


def differs(a: Column, b: Column) -> Column:
    """Whether two listings (structs of sha, size, modified_at) differ.

    Both digests known: they decide. Otherwise size or modification instant, null equal to null.
    """
    return F.when(a["sha"].isNotNull() & b["sha"].isNotNull(), a["sha"] != b["sha"]).otherwise(
        ~(a["size"].eqNullSafe(b["size"]) & a["modified_at"].eqNullSafe(b["modified_at"]))
    )


def listings_of(source_files: DataFrame) -> DataFrame:
    """``run_id, source, name, listing``: one row per file and run, re-deliveries collapsed.

    If a run lists a file in several ways the greatest listing counts. Digests compare in lower
    case, blank ones are missing; modification times by their instant.
    """
    rows = source_files.select("run_id", "source", "name", "size", "modified", "listing_zone", F.nullif(F.lower(F.trim("sha256")), F.lit("")).alias("sha")).distinct()
    timed = with_time_candidates(rows, "modified", "listing_zone", "_c").withColumn("modified_at", by_convention(F.col("_c")))
    listing = F.struct("sha", "size", "modified_at")
    return timed.groupBy("run_id", "source", "name").agg(F.max(listing).alias("listing"))


def run_outcomes(runs: DataFrame) -> DataFrame:
    """``run_id, source, token, ok``: a run is ok if one of its rows says so.

    Tokens number the runs of a source by start time (then id). Runs are a log of a few rows.
    """
    per = runs.groupBy("source", "run_id").agg(
        F.min("started_at").alias("started_at"),
        F.max(F.coalesce(F.lower(F.trim("status")) == "ok", F.lit(False))).alias("ok"),
    )
    w = Window.partitionBy("source").orderBy("started_at", "run_id")
    return per.withColumn("token", F.row_number().over(w))


_LISTING = "struct<sha:string,size:bigint,modified_at:bigint>"
_LEASE = "struct<run_id:bigint,token:int,attempt:int,closed:boolean>"
_ITEM = f"struct<state:string,token:int,leased:{_LISTING},done:{_LISTING},attempts:int,log:array<{_LEASE}>>"


def transitions(events: Column) -> Column:
    """An item's ledger, folded over what its runs did: ``struct(state, token, leased, done, attempts, log)``.

    ``events``: its listings in the order of their tokens, ``struct(token, run_id, ok, listing)``. Each
    goes through the ledger's moves in turn:

    * expire: an item still leased by an earlier token is pending again, as that run ended without
      completing it;
    * lease: the listing is compared with the one last done; a new or changed item is leased under
      the run's token, an unchanged one stays done;
    * complete: a run that ended well completes what it holds, and only what it holds: its token must
      be the item's. Then the leased listing is the one done and the attempts start over.

    ``log`` has one entry per lease: the run, its token, the attempt, and whether its completion was
    accepted. Events that lease nothing leave it as it is.
    """
    none = F.lit(None).cast(_LISTING)
    item = lambda state, token, leased, done, attempts, log: F.struct(
        state.alias("state"), token.alias("token"), leased.alias("leased"), done.alias("done"), attempts.alias("attempts"), log.alias("log")
    )
    start = item(F.lit(PENDING), F.lit(0), none, none, F.lit(0), F.array()).cast(_ITEM)

    def move(it: Column, e: Column) -> Column:
        # Tokens rise: whatever is still leased here belongs to an earlier run, and has expired.
        state = F.when((it["state"] == LEASED) & (it["token"] < e["token"]), PENDING).otherwise(it["state"])
        take = (state != LEASED) & (it["done"].isNull() | differs(e["listing"], it["done"]))
        held = F.when(take, e["token"]).otherwise(it["token"])
        leased = F.when(take, LEASED).otherwise(DONE)
        attempt = it["attempts"] + take.cast("int")
        accepted = e["ok"] & (leased == LEASED) & (held == e["token"])
        after = F.when(accepted, DONE).otherwise(leased)
        entry = F.struct(e["run_id"].alias("run_id"), e["token"].alias("token"), attempt.alias("attempt"), accepted.alias("closed"))
        # A good run also confirms what it found unchanged: later listings compare with that one.
        return item(
            after, held, F.when(take, e["listing"]).otherwise(it["leased"]), F.when(e["ok"], e["listing"]).otherwise(it["done"]),
            F.when(e["ok"], 0).otherwise(attempt), F.when(take, F.concat(it["log"], F.array(entry))).otherwise(it["log"]),
        )

    return F.aggregate(events, start, move)


def ledger(listings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``source, name, item``: every item with its ledger after the last run (see ``transitions``).

    Per item there is at most one listing per run, so the array of an item is bounded by the number
    of runs of its source. Listings of unknown runs are never leased and left out.
    """
    joined = listings.join(outcomes.select("source", "run_id", "token", "ok"), ["source", "run_id"])
    events = F.sort_array(F.collect_list(F.struct("token", "run_id", "ok", "listing")))
    return joined.groupBy("source", "name").agg(events.alias("events")).select("source", "name", transitions(F.col("events")).alias("item"))


def replay(listings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger's log: one row per lease, that is per item and run that had to process it.

    Columns: run_id, source, name, token, attempt (leases since the item was last done), closed
    (whether the completion was accepted; if not the lease expired before the next run), path (of
    the output).
    """
    log = ledger(listings, outcomes).select("source", "name", F.inline("item.log"))
    return log.select("run_id", "source", "name", "token", "attempt", "closed", output_path(F.col("source"), F.col("token")).alias("path"))


def output_path(source: Column, token: Column) -> Column:
    """Where a run writes: the same for every retry of the same lease."""
    return F.concat(F.lit("source="), source, F.lit("/token="), F.lpad(token.cast("string"), 8, "0"))


def taken_in(source_files: DataFrame, runs: DataFrame) -> DataFrame:
    """Problem 3: ``run_id, source, name`` of the items each run leased and completed."""
    return replay(listings_of(source_files), run_outcomes(runs)).where("closed").select("run_id", "source", "name")


class StaleWriter(RuntimeError):
    """A write came with a fencing token that is no longer the current one."""


class WorkLedger:
    """The ledger on shared storage. Items are kept per source; a step writes the items of its own
    source anew, as a listing names them all anyway, and leaves the others alone.

    What is current is said by numbered commits (``CommitLog``): of two writers that read the same
    commit one is refused and starts over from the new one, so no two leases get one token and no
    step is lost. A crash before the commit leaves the old state.
    """

    SCHEMA = f"name string, state string, token bigint, lease_until double, listing {_LISTING}, done {_LISTING}, attempts int"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, folder)

    def _current(self) -> tuple[int, dict]:
        n, p = self.log.latest()
        return n, p or {"items": {}, "tokens": {}}

    def _items(self, p: dict, source: str) -> DataFrame:
        at = p["items"].get(source)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], self.SCHEMA)

    def items(self, source: str) -> DataFrame:
        return self._items(self._current()[1], source)

    def _step(self, source: str, change) -> dict:
        """Applies ``change(items, pointer) -> (items, pointer)`` until its commit is accepted."""
        while True:
            n, p = self._current()
            got = change(self._items(p, source), p)
            if got is None:
                return p
            items, p = got
            name = f"items-{uuid.uuid4().hex}"
            items.select(*[c.split()[0] for c in self.SCHEMA.split(", ")]).write.parquet(f"{self.folder}/{name}")
            p = p | {"items": p["items"] | {source: name}}
            if self.log.add(n + 1, p):
                return p

    def lease(self, source: str, listing: DataFrame, now: float, ttl: float) -> int:
        """Takes a listing (name, listing) in: expired leases become pending, new and changed
        items are leased. Returns the fencing token; the leased items are ``work(source, token)``."""

        def change(old: DataFrame, p: dict) -> tuple[DataFrame, dict]:
            token = p["tokens"].get(source, 0) + 1
            mine = listing.select(F.col("name").alias("_n"), F.col("listing").alias("_l"))
            own = old.join(mine, F.col("name") == F.col("_n"), "full_outer")
            free = F.coalesce((F.col("state") != LEASED) | (F.col("lease_until") <= now), F.lit(True))
            changed = F.col("_l").isNotNull() & (F.col("done").isNull() | differs(F.col("_l"), F.col("done")))
            take = free & changed
            back = F.when((F.col("state") == LEASED) & (F.col("lease_until") <= now), PENDING).otherwise(F.coalesce("state", F.lit(PENDING)))
            settled = free & F.col("_l").isNotNull() & ~changed
            new = own.select(
                F.coalesce("name", "_n").alias("name"),
                F.when(take, LEASED).when(settled, DONE).otherwise(back).alias("state"),
                F.when(take, token).otherwise(F.col("token")).cast("bigint").alias("token"),
                F.when(take, now + ttl).otherwise(F.col("lease_until")).cast("double").alias("lease_until"),
                F.when(take, F.col("_l")).otherwise(F.col("listing")).alias("listing"), "done",
                (F.coalesce("attempts", F.lit(0)) + take.cast("int")).alias("attempts"),
            )
            return new, p | {"tokens": p["tokens"] | {source: token}}

        return self._step(source, change)["tokens"][source]

    def work(self, source: str, token: int) -> DataFrame:
        return self.items(source).where((F.col("token") == token) & (F.col("state") == LEASED))

    def complete(self, source: str, token: int, now: float) -> None:
        """The items still leased under ``token`` are done, whatever tokens were given out since.

        A writer none of whose items carries its token any more is stale and rejected, as is one
        whose leases have run out; repeating a completed call changes nothing.
        """

        def change(old: DataFrame, p: dict) -> tuple[DataFrame, dict] | None:
            held = (F.col("token") == token) & (F.col("state") == LEASED)
            n = old.agg(
                F.coalesce(F.sum(held.cast("int")), F.lit(0)).alias("held"), F.coalesce(F.sum((held & (F.col("lease_until") <= now)).cast("int")), F.lit(0)).alias("late"),
                F.coalesce(F.sum(((F.col("token") == token) & (F.col("state") == DONE)).cast("int")), F.lit(0)).alias("done"),
            ).first()
            if n.late or not (n.held or n.done or p["tokens"].get(source) == token):
                raise StaleWriter(f"{source}: token {token} holds nothing any more")
            if not n.held:
                return None
            return old.withColumns({
                "done": F.when(held, F.col("listing")).otherwise(F.col("done")),
                "attempts": F.when(held, 0).otherwise(F.col("attempts")),
                "state": F.when(held, DONE).otherwise(F.col("state")),
            }), p

        self._step(source, change)
