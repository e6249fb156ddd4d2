"""File-level change detection: a directory listing against what was fetched before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = (
    r"(?i)([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\s+([0-9]{1,2}:[0-9]{2} [AP]M)\s+(<dir>|&lt;dir&gt;|[0-9]+)\s+<A HREF=\"([^\"]+)\""
)


def listing_entries(html: Column) -> Column:
    """``array<struct<name, href, is_dir, size, modified, chapter>>`` of a listing page."""
    g = lambda i: F.regexp_extract_all(html, F.lit(_ROW), F.lit(i))
    rows = F.arrays_zip(g(1).alias("d"), g(2).alias("t"), g(3).alias("s"), g(4).alias("h"))

    def one(r: Column) -> Column:
        bare = F.regexp_replace(r["h"], "/+$", "")
        name = F.url_decode(F.replace(F.substring_index(bare, "/", -1), F.lit("+"), F.lit("%2B")))
        at = F.try_to_timestamp(F.concat_ws(" ", r["d"], F.upper(r["t"])), F.lit("M/d/yyyy h:mm a"))
        return F.struct(
            name.alias("name"), r["h"].alias("href"), (~r["s"].rlike("^[0-9]+$")).alias("is_dir"), r["s"].try_cast("bigint").alias("size"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm").alias("modified"),
            F.nullif(F.upper(F.regexp_extract(name, r"(?i)^Chapter ([0-9]+[A-Z]?)\.xml$", 1)), F.lit("")).alias("chapter"),
        )

    return F.filter(F.transform(rows, one), lambda e: ~F.regexp_replace(e["href"], "/+$", "").endswith("/.."))


def chapter_files(entries: DataFrame) -> DataFrame:
    """Chapter files in natural order; two files of one chapter are an error."""
    files = entries.where(~F.col("is_dir") & F.col("chapter").isNotNull())
    twice = files.groupBy("chapter").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two files for chapter {twice[0].chapter}")
    return files.orderBy(F.regexp_extract("chapter", "^[0-9]+", 0).cast("int"), "chapter")


def plan_fetch(known: DataFrame, listed: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """``keys, action``: fetch (new, changed, never parsed or forced), unchanged or vanished.

    Both sides have keys, size and modified; ``known`` also has sha256.
    """
    k = known.select(*keys, F.col("size").alias("_ks"), F.col("modified").alias("_km"), F.col("sha256").alias("_kh"), F.lit(True).alias("_in_known"))
    joined = listed.select(*keys, "size", "modified", F.lit(True).alias("_listed")).join(k, keys, "full_outer")
    same = F.col("size").eqNullSafe(F.col("_ks")) & F.col("modified").eqNullSafe(F.col("_km")) & F.col("_kh").isNotNull()
    return joined.select(
        *keys, F.when(F.col("_listed").isNull(), "vanished").when(F.lit(force) | F.col("_in_known").isNull() | ~same, "fetch").otherwise("unchanged").alias("action")
    )
