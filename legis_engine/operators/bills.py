"""Targets of pending legislation, from a bill's description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import MCL_LIVE, mcl_key
from ..functions.xrefs import references_in


def bill_targets(description: Column, refs: Column) -> Column:
    """``struct(sections, spans, acts, creates_new_act)`` from a description and the distinct
    references in it: single sections, spans (end null for
    "et seq."), acts amended."""
    mcl = F.filter(refs, lambda r: r["kind"] == "mcl")
    ends = F.transform(F.filter(mcl, lambda r: r["in_range"]), lambda r: r["key"])
    pairs = F.when(F.size(ends) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(ends) / 2).cast("int") - 1), lambda i: F.struct(F.get(ends, i * 2).alias("start"), F.get(ends, i * 2 + 1).alias("end"))))
    none = F.array().cast("array<struct<start:string,end:string>>")
    open_ended = F.transform(
        F.regexp_extract_all(description, F.lit(rf"(?iU)\bMCL\s+({MCL_LIVE})\s+et\s+seq"), F.lit(1)),
        lambda t: F.struct(mcl_key(t).alias("start"), F.lit(None).cast("string").alias("end")),
    )
    spans = F.concat(F.coalesce(pairs, none), open_ended)
    used = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    keys = F.array_distinct(F.transform(mcl, lambda r: r["key"]))
    acts = F.array_distinct(F.transform(F.filter(refs, lambda r: r["kind"] == "public_act"), lambda r: r["key"]))
    return F.struct(
        F.array_sort(F.array_except(keys, used)).alias("sections"), spans.alias("spans"), F.array_sort(acts).alias("acts"),
        description.rlike(r"(?i)\bCreates new act\b").alias("creates_new_act"),
    )


def with_targets(bills: DataFrame, description: str = "description") -> DataFrame:
    refs = bills.withColumn("_refs", F.array_distinct(references_in(F.col(description))))
    return refs.withColumn("_t", bill_targets(F.col(description), F.col("_refs"))).select(*bills.columns, "_t.*")
