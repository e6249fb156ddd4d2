"""Neighbour lookups in an order, safe for hot groups.

``previous_state`` is a ``lag`` that never puts a hot group into one task: groups above a row
limit are cut into buckets of the order column, each bucket is one window group, and only the
first row of each bucket takes its predecessor from the bucket before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 200_000


def mark_hot(df: DataFrame, by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``_hot``. At most rows/hot_rows groups are hot, so the hot list stays small."""
    hot = df.groupBy(F.col(by).alias("_hk")).count().where(F.col("count") > hot_rows).select("_hk", F.lit(True).alias("_hot"))
    return df.join(hot, F.col(by).eqNullSafe(F.col("_hk")), "left").drop("_hk").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def previous_state(
    df: DataFrame, by: str, order: list[Column], bucket: Column, state: Column, out: str, descending: bool = False
) -> DataFrame:
    """``df`` (with ``_hot``) plus ``out``: the state of the preceding row of the group, or null.

    ``order`` must be total in the group, ``bucket`` monotonic in it. ``state`` must not be null.
    With ``descending`` the following row is taken instead.
    """
    marked = df.withColumn("_b", F.when(F.col("_hot"), bucket)).withColumn("_st", state)
    keys = [c.desc() if descending else c.asc() for c in order]
    w = Window.partitionBy(by, "_b").orderBy(*keys)
    inner = marked.withColumn("_p", F.lag("_st").over(w))
    # Per bucket of a hot group only its last state: as many rows as buckets, never as records.
    pick = F.min_by if descending else F.max_by
    ends = (
        marked.where("_hot").groupBy(by, "_b").agg(pick("_st", F.struct(*order)).alias("_end"))
    )
    wb = Window.partitionBy(by).orderBy(F.col("_b").desc() if descending else F.col("_b").asc())
    carry = ends.select(F.col(by).alias("_ck"), F.col("_b").alias("_cb"), F.lag("_end").over(wb).alias("_carry"))
    return (
        inner.join(carry, F.col(by).eqNullSafe(F.col("_ck")) & F.col("_b").eqNullSafe(F.col("_cb")), "left")
        .withColumn(out, F.coalesce("_p", "_carry"))
        .drop("_b", "_st", "_p", "_carry", "_ck", "_cb")
    )
