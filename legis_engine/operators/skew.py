"""Joins that stay spread when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """Key values with more than ``share`` of all rows: at most 1/share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg((F.count(F.lit(1)) * share).alias("_least"))
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_least")).select(*keys)


def skew_left_join(left: DataFrame, right: DataFrame, keys: list[str], share: float = 0.01, hot: DataFrame | None = None) -> DataFrame:
    """Left outer join to ``right``, whose ``keys`` are unique, null keys matching nothing.

    Rows of hot keys meet a broadcast of the few right rows with those keys (at most 1/share);
    the rest is shuffled as usual. ``hot`` gives the hot keys (at most 1/share) where they are known.
    """
    if hot is None:
        hot = hot_keys(left.where(F.col(keys[0]).isNotNull()), keys, share)
    hot = hot.withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(hot), keys, "left")
    few = right.join(F.broadcast(hot.drop("_hot")), keys, "left_semi")
    on_hot = marked.where("_hot").drop("_hot").join(F.broadcast(few), keys, "left")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, "left")
    return on_hot.unionByName(rest)
