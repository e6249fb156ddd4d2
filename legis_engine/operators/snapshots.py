"""What changed between consecutive full deliveries.

Identical rows are removed by EXCEPT ALL in both directions; the residues are full-joined by
key, which labels each key as added, removed or changed. Rows of identical re-deliveries are
collapsed map-side before anything is shuffled, so a hot group of repeats never travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import collapse, normalize_citation


def pack_hash(c: Column) -> Column:
    """Hash text, letter case removed, as bytes: 32 for a well-formed sha-256, else the text.

    A prefix byte keeps the two apart; null stays null.
    """
    low = F.lower(F.trim(c))
    return F.when(
        low.rlike("^(?:[0-9a-f]{2})+$"), F.concat(F.unhex(F.lit("01")), F.unhex(low))
    ).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(low, "UTF-8")))


def consecutive(rows: DataFrame, stream: str, number: str) -> DataFrame:
    """``stream, number, next_number`` for each delivery; one row per delivery, not per record."""
    from pyspark.sql import Window

    numbers = rows.select(stream, number).distinct()
    return numbers.withColumn("next_number", F.lead(number).over(Window.partitionBy(stream).orderBy(number)))


def snapshot_diff(
    rows: DataFrame, stream: str, number: str, keys: list[str], value: str, deliveries: DataFrame | None = None
) -> DataFrame:
    """Changes between each delivery of a stream and its next one.

    ``rows`` holds the current records only; ``deliveries`` names all deliveries if some may
    have no current record. Output: number (the later one), stream, keys, change_type.

    Null keys compare equal to null; a null value is a value of its own. Repeated rows count
    once. If one key has several values in one delivery it is ``changed`` when the value sets
    differ. Empty input gives an empty result; extra columns are ignored.
    """
    pairs = consecutive(deliveries if deliveries is not None else rows, stream, number)
    base = rows.select(stream, number, *keys, value).distinct()
    # Deliveries are few (one row each); the planner broadcasts them only below its size threshold.
    first = pairs.groupBy(F.col(stream).alias("_s")).agg(F.min(number).alias("_first"))
    labelled = base.join(pairs.withColumnRenamed(stream, "_s").withColumnRenamed(number, "_n"),
                         F.col(stream).eqNullSafe(F.col("_s")) & (F.col(number) == F.col("_n"))).drop("_s", "_n")
    cols = [stream, *keys, value]
    newer = (
        base.join(first, F.col(stream).eqNullSafe(F.col("_s")))
        .where(F.col(number) > F.col("_first"))
        .select(F.col(number).alias("_at"), *cols)
    )
    older = labelled.where(F.col("next_number").isNotNull()).select(F.col("next_number").alias("_at"), *cols)
    fresh, gone = newer.exceptAll(older), older.exceptAll(newer)
    side = lambda df, tag: df.groupBy("_at", stream, *keys).agg(F.lit(True).alias(tag))
    a, b = side(fresh, "_in_new").alias("a"), side(gone, "_in_old").alias("b")
    on = None
    for c in ("_at", stream, *keys):
        term = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = term if on is None else on & term
    joined = a.join(b, on, "full_outer")
    return joined.select(
        F.coalesce("a._at", "b._at").cast("bigint").alias(number),
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (stream, *keys)],
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").otherwise("changed").alias("change_type"),
    )


def corpus_changes(snapshots: DataFrame) -> DataFrame:
    """Problem 2 over ``corpus_snapshots``: keys canonical, null variant empty, current rows only.

    A citation no grammar accepts is compared by its collapsed text. Rows without a snapshot
    number belong to no delivery.
    """
    rows = snapshots.select(
        "snapshot_no",
        F.lower(F.trim("source")).alias("source"),
        F.coalesce(normalize_citation(F.col("citation")), collapse(F.col("citation"))).alias("citation"),
        F.coalesce("variant", F.lit("")).alias("variant"),
        pack_hash(F.col("content_hash")).alias("hash"),
        "is_current",
    )
    current = rows.where(F.col("is_current"))
    return snapshot_diff(current, "source", "snapshot_no", ["citation", "variant"], "hash", deliveries=rows).select(
        "snapshot_no", "source", "citation", "variant", "change_type"
    )
