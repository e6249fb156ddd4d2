"""The read operators on small made-up tables."""

from legis_engine.operators.service import range_hits

RANGES = [("MCL 5.1", "MCL 5.9", "a"), ("MCL 5.4", "MCL 5.6", "b"), ("MCL 8.50", "MCL 10.3", "across"), ("MCL 12A.1", "MCL 12A.9", "letter")]
KEYS = ["MCL 5.5", "MCL 5.20", "MCL 8.49", "MCL 9.1", "MCL 10.3", "MCL 10.4", "MCL 12.5", "MCL 12A.5", "MCL 700.1", None]


def test_references_outside_all_ranges_stay(spark):
    refs = spark.createDataFrame([(k,) for k in KEYS], "key string")
    ranges = spark.createDataFrame(RANGES, "start_citation string, end_citation string, name string")
    got = {(r.key, r.name) for r in range_hits(refs, ranges).collect()}
    assert got == {("MCL 5.5", "a"), ("MCL 5.5", "b"), ("MCL 9.1", "across"), ("MCL 10.3", "across"), ("MCL 12A.5", "letter")} | {
        (k, None) for k in ("MCL 5.20", "MCL 8.49", "MCL 10.4", "MCL 12.5", "MCL 700.1", None)
    }
