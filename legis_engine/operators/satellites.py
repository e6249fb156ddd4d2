"""History of changing attributes kept in insert-only satellites.

Attributes are split by how fast they change; each satellite gets a row only when the hash of
its attributes differs from the row before it. Nothing is ever updated: end dates come from
lead-based views over the satellites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, mark_hot, previous_state


def hash_diff(*attrs: Column) -> Column:
    """128-bit digest of the attributes, nulls told apart from empty text."""
    return F.unhex(F.md5(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), a.cast("string")), F.lit("n")) for a in attrs])).cast("binary")))


def build_satellite(
    obs: DataFrame, key: str, at: str, attrs: list[str], tie: list[str] | None = None, after: DataFrame | None = None, log: DataFrame | None = None
) -> DataFrame:
    """Rows to insert into a satellite: ``key, at, tie, attrs, hash_diff`` where the digest changes.

    ``obs`` has ``_hot`` (see ``mark_hot``); a row that repeats another changes nothing. ``tie``
    names the columns that order observations of one instant; satellites that are to be viewed
    together must share them, or the states of one instant would be put together crosswise.

    ``after`` holds the satellite so far and ``log`` the observations it was built from. Rows later
    than the newest row of their key are appended if they differ from it. Keys with a late row are
    built anew from log and obs, and the rows the satellite lacks are inserted; rows in it that are
    no changes any more stay, and the view passes over them. Rows without a time are not
    observations.
    """
    tie = tie or []
    digest = hash_diff(*[F.col(a) for a in attrs])
    shape = lambda df: df.where(F.col(at).isNotNull()).select(
        key, at, *tie, *[a for a in attrs if a not in tie], "_hot", digest.alias("hash_diff")
    )
    rows, order = shape(obs), F.struct(at, *tie, "hash_diff")
    rows = rows.withColumn("_last", F.lit(None).cast("binary"))
    if after is not None:
        if log is None:
            raise ValueError("a satellite is carried on with the observations it was built from")
        newest = after.groupBy(F.col(key).alias("_nk")).agg(F.max(order).alias("_newest"))
        met = rows.drop("_last").join(newest, F.col(key).eqNullSafe(F.col("_nk")), "left")
        late = met.where(order <= F.col("_newest")).select(F.col(key).alias("_lk")).distinct()
        of_late = lambda df, how: df.join(late, F.col(key).eqNullSafe(F.col("_lk")), how)
        fresh = of_late(met, "left_anti").withColumn("_last", F.col("_newest.hash_diff")).drop("_nk", "_newest")
        again = of_late(rows.drop("_last", "_hot").unionByName(shape(log).drop("_hot")).distinct(), "left_semi")
        rows = fresh.unionByName(mark_hot(again, key).withColumn("_last", F.lit(None).cast("binary")))
    seen = previous_state(rows, key, [F.col(at), *[F.col(t) for t in tie], F.col("hash_diff")], F.substring(F.col(at).cast("string"), 1, 7), F.col("hash_diff"), "_prev")
    before = F.coalesce("_prev", "_last")
    made = seen.where(before.isNull() | (before != F.col("hash_diff"))).select(key, at, *tie, *[a for a in attrs if a not in tie], "hash_diff", "_hot")
    if after is None:
        return made
    have = after.select(*[F.col(c).alias(f"_h_{c}") for c in (key, at, *tie, "hash_diff")])
    same = None
    for c in (key, at, *tie, "hash_diff"):
        term = F.col(c).eqNullSafe(F.col(f"_h_{c}"))
        same = term if same is None else same & term
    return made.join(have, same, "left_anti")


def history_view(
    satellites: dict[str, DataFrame], key: str, at: str, attrs: dict[str, list[str]], tie: list[str] | None = None, late: bool = True
) -> DataFrame:
    """One row per version: ``key, valid_from, valid_to, attrs`` (valid_to null for the last).

    A version starts where a satellite has a row that changes something; each satellite's attributes
    are those of its latest row then. States of one instant follow each other in the order of
    ``tie``, all but the last being valid for that instant only. ``late`` says that rows may have been
    inserted late, so that some repeat the state before them and must be passed over. Hot keys are
    cut into months like everywhere else.
    """
    names, tie = list(satellites), tie or []
    order = F.struct(at, *tie).alias("_o")
    starts = None
    for n in names:
        part = satellites[n].select(
            key, at, order, "_hot",
            *[(F.struct(*attrs[m]) if m == n else F.lit(None).cast(satellites[m].select(F.struct(*attrs[m])).schema[0].dataType)).alias(f"_{m}") for m in names],
        )
        starts = part if starts is None else starts.unionByName(part)
    merged = starts.groupBy(key, at, "_o", "_hot").agg(*[F.max(f"_{n}").alias(f"_{n}") for n in names])
    # Carry each satellite's attributes forward inside the bucket, then across buckets of hot keys.
    month = F.substring(F.col(at).cast("string"), 1, 7)
    merged = merged.withColumn("_b", F.when(F.col("_hot"), month))
    by = Window.partitionBy(key, "_b").orderBy("_o")
    carried = by.rowsBetween(Window.unboundedPreceding, 0)
    filled = merged.select(
        key, at, "_o", "_hot", "_b", *[F.last(f"_{n}", ignorenulls=True).over(carried).alias(f"_{n}") for n in names], F.lead(at).over(by).alias("_to")
    )
    ends = merged.where("_hot").groupBy(key, "_b").agg(
        F.min(at).alias("_start"), *[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("_o"))).alias(f"_e_{n}") for n in names]
    )
    wb = Window.partitionBy(key).orderBy("_b")
    carry = ends.select(
        F.col(key).alias("_ck"), F.col("_b").alias("_cb"), F.lead("_start").over(wb).alias("_after"),
        *[F.last(f"_e_{n}", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{n}") for n in names],
    )
    joined = filled.join(carry, F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_b") == F.col("_cb")), "left")
    state = F.struct(*[F.coalesce(f"_{n}", f"_c_{n}").alias(n) for n in names])
    out = [F.col(f"_v.{n}.{a}").alias(a) for n in names for a in attrs[n]]
    if not late:
        return joined.withColumn("_v", state).select(key, F.col(at).alias("valid_from"), F.coalesce("_to", "_after").alias("valid_to"), *out)
    # Rows that late insertions made superfluous repeat the state before them.
    seen = previous_state(joined.select(key, at, "_o", "_hot", state.alias("_v")), key, [F.col("_o")], month, F.col("_v"), "_before")
    kept = seen.where(F.col("_before").isNull() | (F.col("_before") != F.col("_v")))
    ended = previous_state(kept.drop("_before"), key, [F.col("_o")], month, F.struct(F.col(at).alias("to")), "_next", descending=True)
    return ended.select(key, F.col(at).alias("valid_from"), F.col("_next.to").alias("valid_to"), *out)


def clean_status(c: Column) -> Column:
    """Lower case without outer blanks and closing full stop."""
    return F.trim(F.regexp_replace(F.trim(F.lower(c)), r"\.+$", ""))


def document_history(versions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Problem 5 over ``versions``: document_id, valid_from, valid_to, status.

    The content digest (fast) and the status (slow) are separate satellites. Re-delivered rows
    count once, rows without first_seen are no observations, null status or hash is a state of
    its own, valid_to of the last version is empty. Two states at one instant are two versions in
    the order of content hash and status, the first of them ending where it starts. Empty input
    gives an empty result.
    """
    state = F.struct(F.lower(F.trim("content_hash")).alias("content_hash"), clean_status(F.col("status")).alias("status"))
    seen = versions.where(F.col("first_seen").isNotNull()).groupBy("document_id", "first_seen").agg(F.sort_array(F.collect_set(state)).alias("_states"))
    # Re-deliveries are gone here; of one instant there are as many states as differ, and they are numbered.
    obs = seen.select("document_id", "first_seen", F.posexplode("_states").alias("seq", "s")).select("document_id", "first_seen", "seq", "s.*")
    obs = mark_hot(obs, "document_id", hot_rows)
    tie = ["seq"]
    sats = {
        "content": build_satellite(obs, "document_id", "first_seen", ["content_hash"], tie),
        "state": build_satellite(obs, "document_id", "first_seen", ["status"], tie),
    }
    view = history_view(sats, "document_id", "first_seen", {"content": ["content_hash"], "state": ["status"]}, tie, late=False)
    return view.select("document_id", "valid_from", F.coalesce("valid_to", F.lit("")).alias("valid_to"), "status")
