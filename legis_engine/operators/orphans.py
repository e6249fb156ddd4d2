"""References to records that do not exist.

``OrphanState`` is keyed by parent and moves batch by batch: new references probe the parent
index, arriving parents resolve the orphans that wait for them, deletions open a parent's
references again. Each batch appends its own part to the state and touches only the keys it has
news of; nothing is rewritten. ``replay`` feeds a backlog through it period by period.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.citations import collapse, normalize_act, normalize_citation
from ..functions.timestamps import iso_date
from ..session import materialize, shared_dir
from .skew import hot_keys, skew_left_join

DOCS, ACTS = "documents", "public_acts"
KEY = ["to_table", "kind", "key"]
ALWAYS = -(1 << 62)  # time of arrival of a parent that has none


def kind_letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^A-Za-z]", ""))


def utc_seconds(c: Column, kind: str) -> Column:
    """Seconds since 1970 of a time column; one without a zone is UTC whatever the session's zone."""
    if kind == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)
    return F.unix_seconds(c.cast("timestamp"))


def month_of(seconds: Column) -> Column:
    return F.substring(iso_date(seconds), 1, 7)


def parent_index(documents: DataFrame, public_acts: DataFrame) -> DataFrame:
    """``to_table, kind, key, born, died``: one row per possible target.

    Only ordinary forms (empty or null variant) are targets. Repeated parents count once: from
    their earliest arrival, and as removed only if every repetition is. Times are UTC seconds.
    """
    sec = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    docs = documents.where(F.coalesce("variant", F.lit("")) == "").select(
        F.lit(DOCS).alias("to_table"), kind_letters(F.col("source")).alias("kind"), F.col("citation").alias("key"),
        sec(F.col("first_seen")).alias("born"), sec(F.col("removed_at")).alias("died"),
    )
    acts = public_acts.select(
        F.lit(ACTS).alias("to_table"), F.lit("publicact").alias("kind"), F.col("act_citation").alias("key"),
        sec(F.col("recorded_at")).alias("born"), F.lit(None).cast("bigint").alias("died"),
    )
    far = F.lit(1 << 60)
    return docs.unionByName(acts).where(F.col("key").isNotNull()).groupBy("to_table", "kind", "key").agg(
        F.min("born").alias("born"), F.nullif(F.max(F.coalesce("died", far)), far).alias("died")
    )


def references(xrefs: DataFrame) -> DataFrame:
    """``xref_id, to_table, kind, key, found``: re-delivered rows once, null keys left out.

    A key the grammar does not accept keeps its collapsed text and so meets no parent.
    """
    rows = xrefs.where(F.col("to_key").isNotNull()).select("xref_id", "to_kind", "to_key", "found_at").distinct()
    kind = F.coalesce(kind_letters(F.col("to_kind")), F.lit(""))
    act = kind == "publicact"
    key = F.coalesce(F.when(act, normalize_act(F.col("to_key"))).otherwise(normalize_citation(F.col("to_key"))), collapse(F.col("to_key")))
    return rows.select(
        "xref_id", F.when(act, ACTS).otherwise(DOCS).alias("to_table"), kind.alias("kind"), key.alias("key"),
        utc_seconds(F.col("found_at"), dict(xrefs.dtypes)["found_at"]).alias("found"),
    )


def parent_events(parents: DataFrame) -> DataFrame:
    """``to_table, kind, key, t, dead``: the arrival and the removal of each row of the parent index.

    A parent without a date of arrival was always there; one removed before it arrived is removed
    at its arrival.
    """
    born = F.coalesce("born", F.lit(ALWAYS))
    one = lambda t, dead: F.struct(t.alias("t"), F.lit(dead).alias("dead"))
    life = F.array(one(born, False), F.when(F.col("died").isNotNull(), one(F.greatest(born, F.col("died")), True)))
    return parents.select(*KEY, F.explode(F.filter(life, lambda e: e.isNotNull())).alias("e")).select(*KEY, "e.t", "e.dead")


class OrphanState:
    """Pending-orphan state in a folder of the shared file system; every table is appended per batch.

    ``life``: arrivals and deletions of parents. ``probe``: references with what they met when they
    were found (status null, deleted, later or missing; the missing ones wait). ``seen``: how many
    references of each parent a batch brought, which is all a deletion needs to open them again.
    ``closed``: waiting references whose parent came. ``moves``: openings and closings per month.

    The latest event of a parent decides whether it is there; at one instant a deletion counts after
    an arrival, so a parent that arrives again after its deletion is there again. A parent known by
    a deletion only was there before it. Events and references delivered again inside a batch count
    once, events also across batches. Batches come in the order of time: an event older than what is
    known of its parent is kept but changes nothing, and outcomes once reported stay as they are.
    A batch that failed is repeated under its number and replaces its own output.
    """

    TABLES = {
        "life": "to_table string, kind string, key string, t bigint, dead boolean, batch int",
        "probe": "xref_id bigint, to_table string, kind string, key string, found bigint, status string, arrived bigint, turns array<struct<t:bigint,dead:boolean>>",
        "seen": "to_table string, kind string, key string, n bigint",
        "closed": "xref_id bigint, to_table string, kind string, key string, found bigint, status string, arrived bigint",
        "moves": "to_table string, reason string, period string, d bigint",
    }

    def __init__(self, spark: SparkSession, folder: str, batches: int = 0):
        self.spark, self.folder, self.batches = spark, folder.rstrip("/"), batches

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        return cls(spark, f"{shared_dir(spark).rstrip('/')}/tables/orphans-{uuid.uuid4().hex}")

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        n = self.batches if upto is None else upto
        read = self.spark.read.schema(self.TABLES[name])
        return read.parquet(*[f"{self.folder}/{name}/batch-{b:06d}" for b in range(n)]) if n else self.spark.createDataFrame([], self.TABLES[name])

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/batch-{self.batches:06d}"
        df.select(*[c.split()[0] for c in self.TABLES[name].split(", ")]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.TABLES[name]).parquet(path)

    def _parents(self, life: DataFrame) -> DataFrame:
        """One row per parent: its events in order, the turns this batch brings, whether it is new.

        A parent has as many events as it has lives, re-deliveries set aside. A turn is a change
        between there and deleted; the first arrival is none, as nothing was open as deleted.
        """
        event, old = F.struct("t", "dead"), F.col("batch") < self.batches
        per = life.groupBy(*KEY).agg(F.sort_array(F.collect_set(event)).alias("life"), F.max(F.when(old, event)).alias("_known"), F.min("batch").alias("_first"))
        was_dead = lambda i, x: F.when(i > 0, F.get("life", i - 1)["dead"]).otherwise(F.when(x["dead"], False))
        turn = lambda x, i: (F.col("_known").isNull() | (x > F.col("_known"))) & (was_dead(i, x) != x["dead"])
        return per.select(*KEY, "life", F.filter("life", turn).alias("turns"), (F.col("_first") == self.batches).alias("new"))

    def step(self, refs: DataFrame, events: DataFrame, hot: DataFrame | None = None) -> OrphanState:
        """The state after a batch of references (xref_id, KEY, found) and parent events (KEY, t, dead).

        ``hot`` names keys with a large share of all references, if they are known already.
        """
        b = self.batches
        fresh = events.select(*KEY, "t", "dead").distinct().join(self.table("life"), [*KEY, "t", "dead"], "left_anti")
        self._put("life", fresh.withColumn("batch", F.lit(b)))
        parents = self._parents(self.table("life", b + 1))
        found, met = F.col("found"), F.filter("life", lambda x: x["t"] <= F.col("found"))
        first, last = F.get("life", F.lit(0)), F.try_element_at("_met", F.lit(-1))
        probed = skew_left_join(refs.select("xref_id", *KEY, "found").distinct(), parents, KEY, hot=hot).withColumn("_met", met)
        status = (
            F.when(F.col("life").isNull(), "missing").when(found.isNull(), None)
            .when(F.size("_met") == 0, F.when(~first["dead"], "later")).when(last["dead"], "deleted")
        )
        probed = probed.withColumns({"status": status, "turns": F.filter("turns", lambda x: x["t"] > F.col("found"))})
        probed = probed.withColumn("arrived", F.when(F.col("status") == "later", first["t"]))
        # Who waited for a parent that is new in this batch.
        waiting = self.table("probe", b).where("status = 'missing'").select("xref_id", *KEY, "found")
        came = skew_left_join(waiting, parents.where("new"), KEY, hot=hot).where("life is not null")
        late = ~first["dead"] & (first["t"] > found)
        came = came.select("xref_id", *KEY, "found", F.when(late, "later").alias("status"), F.when(late, first["t"]).alias("arrived"))
        probe, closed = self._put("probe", probed), self._put("closed", came)
        # Openings and closings; of references found earlier their number is enough.
        move = lambda reason, t, d: F.struct(F.lit(reason).alias("reason"), t.alias("t"), d.cast("bigint").alias("d"))
        turned = F.transform("turns", lambda x: move("deleted", x["t"], F.when(x["dead"], 1).otherwise(-1)))
        waited = F.when(F.col("status") == "later", F.array(move("later", found, F.lit(1)), move("later", F.col("arrived"), F.lit(-1))))
        opened = F.when(F.col("status") == "deleted", F.array(move("deleted", found, F.lit(1))))
        none = F.array().cast("array<struct<reason:string,t:bigint,d:bigint>>")
        earlier = self.table("seen", b).groupBy(*KEY).agg(F.sum("n").alias("n"))
        again = parents.where(F.size("turns") > 0).join(earlier, KEY).select("to_table", "n", F.inline(turned))
        steps = (
            probe.select("to_table", F.inline(F.concat(F.coalesce(waited, opened, none), turned)))
            .unionByName(closed.where("status is not null").select("to_table", F.inline(waited)))
            .unionByName(again.select("to_table", "reason", "t", (F.col("n") * F.col("d")).alias("d")))
        )
        moves = steps.groupBy("to_table", "reason", month_of(F.col("t")).alias("period")).agg(F.sum("d").alias("d"))
        self._put("moves", moves)
        self._put("seen", probe.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
        return OrphanState(self.spark, self.folder, b + 1)

    def _missing(self) -> DataFrame:
        """References that still wait."""
        a, b = self.table("probe").where("status = 'missing'").alias("a"), self.table("closed").alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("xref_id", *KEY, "found")])
        return a.join(b, same, "left_anti")

    def orphans(self) -> DataFrame:
        """``xref_id, to_table, period, reason`` of every reference that was an orphan when it was found."""
        kept = ["xref_id", "to_table", "found", F.col("status").alias("reason")]
        settled = self.table("probe").where(F.col("status").isin("deleted", "later")).select(*kept).unionByName(self.table("closed").where("status is not null").select(*kept))
        every = settled.unionByName(self._missing().select(*kept))
        return every.select("xref_id", "to_table", month_of(F.col("found")).alias("period"), "reason")

    def snapshot_counts(self) -> DataFrame:
        """``period, to_table, reason, open_orphans``: orphans open at the end of each month from the
        first to the last in which any number moved, months without a move included.

        Waiting orphans count as later once their parent has come and as missing while it has not.
        """
        still = self._missing().groupBy("to_table", F.lit("missing").alias("reason"), month_of(F.col("found")).alias("period")).agg(F.count(F.lit(1)).alias("d"))
        monthly = self.table("moves").unionByName(still).groupBy("to_table", "reason", "period").agg(F.sum("d").alias("d"))
        # From here on there are as many rows as months, tables and reasons.
        day = F.to_date(F.concat("period", F.lit("-01")))
        first = monthly.agg(F.min(day).alias("a"), F.max(day).alias("b"))
        months = first.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("_m")).select(F.date_format("_m", "yyyy-MM").alias("period"))
        grid = months.join(F.broadcast(monthly.select("to_table", "reason").distinct()), F.lit(True))
        dated = grid.join(monthly, ["to_table", "reason", "period"], "left").unionByName(monthly.where("period is null").select("to_table", "reason", "period", "d"))
        w = Window.partitionBy("to_table", "reason").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
        return dated.select("period", "to_table", "reason", F.coalesce(F.sum("d").over(w), F.lit(0)).cast("bigint").alias("open_orphans"))

    def references(self) -> DataFrame:
        """``xref_id, found, open`` of all references, as things stand after the last batch."""
        now = self._parents(self.table("life")).select(*KEY, F.element_at("life", -1)["dead"].alias("_dead"))
        return skew_left_join(self.table("probe"), now, KEY).select("xref_id", "to_table", "found", F.coalesce("_dead", F.lit(True)).alias("open"))


def replay(refs: DataFrame, events: DataFrame, months: int = 24) -> OrphanState:
    """A backlog through the state in batches of ``months`` calendar months.

    The result does not depend on ``months``. References without a time come last. References are
    laid out by batch once, so each step reads its own; only the numbers of the batches and at most
    a hundred hot keys are looked at outside.
    """
    spark = refs.sparkSession
    last, first = F.lit(1 << 30), F.lit(-1)
    day = lambda t: F.timestamp_add("SECOND", t, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    ordinal = lambda t: F.coalesce(F.floor((F.year(day(t)) * 12 + F.month(day(t)) - 1) / months).cast("int"), last)
    state = OrphanState.empty(spark)
    at = f"{state.folder}/backlog"
    placed = refs.withColumn("batch", ordinal(F.col("found")))
    timed = events.withColumn("batch", F.when(F.col("t") == ALWAYS, first).otherwise(ordinal(F.col("t"))))
    placed.write.partitionBy("batch").parquet(at)
    laid, dated = spark.read.schema(placed.schema).parquet(at), materialize(timed, "parent_events")
    numbers = sorted(r.batch for r in laid.select("batch").union(dated.select("batch")).distinct().collect())
    hot = materialize(hot_keys(laid, KEY), "hot_keys")
    for n in numbers:
        state = state.step(laid.where(F.col("batch") == n).drop("batch"), dated.where(F.col("batch") == n).drop("batch"), hot)
    return state


def orphan_state(xrefs: DataFrame, documents: DataFrame, public_acts: DataFrame, months: int = 24) -> OrphanState:
    return replay(references(xrefs), parent_events(parent_index(documents, public_acts)), months)


def orphan_references(xrefs: DataFrame, documents: DataFrame, public_acts: DataFrame, months: int = 24) -> DataFrame:
    """Problem 4, from the incremental state. Empty tables give no rows (without parents every
    reference is missing)."""
    return orphan_state(xrefs, documents, public_acts, months).orphans()
