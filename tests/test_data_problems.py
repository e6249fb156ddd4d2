"""The general data operators: worked cases, brute force, and rows nobody should send."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from legis_engine.commits import CommitLog
from legis_engine.functions.timestamps import by_convention, iso_date, iso_instant, with_date_candidates, with_day, with_instant, with_time_candidates
from legis_engine.operators import viterbi
from legis_engine.operators.ledger import StaleWriter, WorkLedger, listings_of, replay, run_outcomes, taken_in, transitions
from legis_engine.operators.orphans import OrphanState, orphan_references, orphan_state
from legis_engine.operators.satellites import build_satellite, document_history, history_view, mark_hot
from legis_engine.operators.snapshots import corpus_changes
from legis_engine.operators.timestamps import normalise_times

# --- problem 1 ------------------------------------------------------------------------------------

INSTANTS = {
    "2022-07-22T07:11": "2022-07-22T11:11:00Z", " 2020-12-13 16:17:04 ": "2020-12-13T21:17:04Z", "2021-05-06T17:43:00Z": "2021-05-06T17:43:00Z",
    "2023-05-26T21:44:55-04:00": "2023-05-27T01:44:55Z", "01-Nov-2015 00:37": "2015-11-01T04:37:00Z", "3/10/2019 2:08 AM": "2019-03-10T07:08:00Z",
    "11/3/2019  1:14 AM": "2019-11-03T05:14:00Z", "1572470818": "2019-10-30T21:26:58Z", "1782867498242": "2026-07-01T00:58:18Z",
    "Sat, 14 May 2022 11:49:00 UTC": "2022-05-14T11:49:00Z", "2021-11-18T16:17:39.142-0500": "2021-11-18T21:17:39Z", "2020-01-29 08:52 america/menominee": "2020-01-29T14:52:00Z",
    "Nov 26, 2019 3:30 a.m. CST": "2019-11-26T09:30:00Z", "20221212T025324Z": "2022-12-12T02:53:24Z", "Tue, 09 Jan 24 16:10:15 GMT": "2024-01-09T16:10:15Z",
    "Thu, 11 Jan 2024 18:48:06 +0930": "2024-01-11T09:18:06Z", "mon, 08 jan 2024 06:46:47 est": "2024-01-08T11:46:47Z", "12/1/2021 12:05 PM": "2021-12-01T17:05:00Z", "12/1/2021 12:05 AM": "2021-12-01T05:05:00Z",
    "13/45/2025 9:61 AM": None, "25/12/2021 1:00 PM": None, "2026-04-12": None, "25:10": None, "2025-02-30T10:15": None, "2025-01-01T24:00": None, "2025-01-01T10:00 XYZ": None, "": None, "-": None, None: None,
}
DATES = {
    "Dec. 31, 1986": "1986-12-31", "July 16, 1890.": "1890-07-16", "1902-02-25": "1902-02-25", "25 Dec 1955": "1955-12-25", "3/25/02": "2002-03-25", "Sep. 30,1935": "1935-09-30",
    "  Sept.  18,  1983 ": "1983-09-18", "Oct. 20, 2021": "2021-10-20", "September 20th, 1995": "1995-09-20", "19380513": "1938-05-13", "the 12th day of June, 1940": "1940-06-12",
    "April 13, 1970, 12:01 a.m. EST": "1970-04-13", "April 17, 1995, at noon": "1995-04-17", "Feb. 29, 1975": None, "Aug. 1975": None, "1950": None, "13/40/1990": None, "on approval": None, None: None,
}


def test_bare_digits_by_their_number(spark):
    want = {
        "599616000": "1989-01-01T00:00:00Z", "599616000000": "1989-01-01T00:00:00Z", "100000000": "1973-03-03T09:46:40Z", "4102444800": "2100-01-01T00:00:00Z",
        "9999999999999": "2286-11-20T17:46:39Z", "20221212": None, "20221212025324": None,
    }
    df = spark.createDataFrame([(v, "America/Detroit") for v in want], "v string, z string")
    got = with_time_candidates(df, "v", "z", "c").select("v", iso_instant(by_convention(F.col("c"))).alias("n"), F.size("c").alias("k")).collect()
    assert {r.v: r.n for r in got} == want and all(r.k <= 1 for r in got)


def test_readings_by_convention(spark):
    df = spark.createDataFrame([(v, "America/Detroit") for v in INSTANTS], "v string, z string")
    got = with_time_candidates(df, "v", "z", "c").select("v", iso_instant(by_convention(F.col("c"))).alias("n")).collect()
    assert {r.v: r.n for r in got} == INSTANTS
    df = spark.createDataFrame([(v,) for v in DATES], "v string")
    got = with_date_candidates(df, "v", "c").select("v", iso_date(by_convention(F.col("c"))).alias("n")).collect()
    assert {r.v: r.n for r in got} == DATES


def test_readings_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        test_readings_by_convention(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def brute_path(rows):
    best = {(): 0}
    prev = None
    for cands in rows:
        if not cands:
            best = {p + (-1,): c for p, c in best.items()}
            continue
        new = {}
        for p, c in best.items():
            for i, (form, at, breaks) in enumerate(cands):
                cost = c + breaks * viterbi.BREAK
                if prev is not None:
                    f, a, _ = prev[next(x for x in reversed(p) if x >= 0)]
                    cost += viterbi.SWITCH * (f != form) + viterbi.BACKWARD * (at < a)
                new[p + (i,)] = cost
        best, prev = new, cands
    return min(best.values(), default=0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_path_over_blocks_costs_what_a_single_pass_costs(spark, seed):
    rnd = random.Random(seed)
    groups = {"hot": 14, "b": 3, "c": 1, None: 4}
    rows, want = [], {}
    for g, n in groups.items():
        made = [[(rnd.randint(0, 2), rnd.randint(0, 9), rnd.choice([0, 0, 1])) for _ in range(rnd.choice([0, 1, 2, 2]))] for _ in range(n)]
        want[g] = brute_path(made)
        rows += [(g, i, c) for i, c in enumerate(made)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, cands array<struct<form:int,at:bigint,breaks:int>>")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = viterbi.choose_path(df, "g", ["i"], "cands").orderBy("g", "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    for g in groups:
        path = [r.chosen for r in got if r.g == g and r.chosen]
        cost = sum(c.breaks for c in path) * viterbi.BREAK + sum(viterbi.SWITCH * (a.form != b.form) + viterbi.BACKWARD * (b.at < a.at) for a, b in zip(path, path[1:], strict=False))
        assert cost == want[g]
        assert all(r.chosen is None for r in got if r.g == g and not r.cands)


@pytest.mark.parametrize(("seed", "batch"), [(4, 3), (5, 7), (6, 10_000)])
def test_path_over_batches_and_blocks_of_long_orders(spark, seed, batch):
    """Long orders of mostly certain records, cut into blocks and tiny batches, against one pass over each."""
    rnd = random.Random(seed)
    rows, want = [], {}
    for g, n in {"hot": 150, "b": 40, "c": 1, None: 25}.items():
        made = [[(rnd.randint(0, 2), rnd.randint(0, 30), rnd.choice([0, 0, 1])) for _ in range(rnd.choice([0, 1, 1, 1, 1, 2, 3]))] for _ in range(n)]
        told = [c for c in made if c]
        d = [c[2] * viterbi.BREAK for c in told[0]] if told else [0]
        for prev, cur in zip(told, told[1:], strict=False):
            d = [min(d[i] + viterbi.SWITCH * (a[0] != c[0]) + viterbi.BACKWARD * (c[1] < a[1]) for i, a in enumerate(prev)) + c[2] * viterbi.BREAK for c in cur]
        want[g] = min(d)
        rows += [(g, i, c) for i, c in enumerate(made)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, cands array<struct<form:int,at:bigint,breaks:int>>")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = viterbi.choose_path(df, "g", ["i"], "cands").orderBy("g", "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(rows) and all((r.chosen is None) == (not r.cands) for r in got) and all(r.chosen in r.cands for r in got if r.cands)
    for g in want:
        path = [r.chosen for r in got if r.g == g and r.chosen]
        cost = sum(c.breaks for c in path) * viterbi.BREAK + sum(viterbi.SWITCH * (a.form != b.form) + viterbi.BACKWARD * (b.at < a.at) for a, b in zip(path, path[1:], strict=False))
        assert cost == want[g]


def test_ambiguous_dates_follow_their_neighbours(spark):
    """Without stated conventions the order decides: 3/4 between 2 April and 5 April is 3 April."""
    day = lambda m, d: int(datetime(2024, m, d).timestamp())
    rows = [("s", 1, [(0, day(4, 2), 0)]), ("s", 2, [(4, day(3, 4), 0), (4, day(4, 3), 0)]), ("s", 3, [(0, day(4, 5), 0)])]
    df = spark.createDataFrame(rows, "g string, i int, cands array<struct<form:int,at:bigint,breaks:int>>")
    assert [r.chosen.at for r in viterbi.choose_path(df, "g", ["i"], "cands").orderBy("i").collect()][1] == day(4, 3)


def p1_tables(spark, files, feed=(), hist=()):
    return {
        "source_files": spark.createDataFrame(list(files), "entry_id bigint, source string, modified string, listing_zone string, cands string, _group int"),
        "feed_events": spark.createDataFrame(list(feed), "event_id bigint, published string"),
        "history_entries": spark.createDataFrame(list(hist), "entry_id bigint, document_id bigint, effective_raw string"),
    }


def test_problem_1(spark):
    t = p1_tables(
        spark,
        [(1, "mcl", "3/10/2019 2:08 AM", "America/Detroit", "x", 1), (1, "mcl", "3/10/2019 2:08 AM", "America/Detroit", "y", 2), (2, None, "2020-01-01T00:00", None, None, None),
         (3, "mcl", "junk", "No/Where", None, None), (4, "mcl", "2020-01-01T00:00", "No/Where", None, None), (5, "mcl", None, None, None, None)],
        [(1, "2024-01-01 10:00:00"), (2, "yesterday" * 5000)], [(1, 9, "Jan. 2, 1999"), (2, None, "1/2/99")],
    )
    got = {(r.src_table, r.row_id, r.normal_form) for r in normalise_times(t).collect()}
    assert got == {
        ("source_files", 1, "2019-03-10T07:08:00Z"), ("source_files", 2, "2020-01-01T00:00:00Z"), ("source_files", 4, "2020-01-01T00:00:00Z"),
        ("feed_events", 1, "2024-01-01T10:00:00Z"), ("history_entries", 1, "1999-01-02"), ("history_entries", 2, "2099-01-02"),
    }
    assert normalise_times(p1_tables(spark, [])).count() == 0


def test_problem_1_depends_on_the_value_alone(spark):
    """Neighbours, source and document decide nothing: no path is searched, and a value of a row id under several of them is one row."""
    files = [(i, s, v, "UTC", None, None) for i, s, v in [(1, "mcl", "2021-12-24T13:00"), (1, "mcr", "2021-12-24T13:00"), (1, None, "2021-12-24T13:00"), (2, "mcl", "25/12/2021 1:00 PM"), (3, "mcl", "2021-12-26T13:00")]]
    got = normalise_times(p1_tables(spark, files, hist=[(1, 9, "1/2/99"), (1, 10, "1/2/99"), (2, 9, "25/12/1999")]))
    want = [("history_entries", 1, "2099-01-02"), ("source_files", 1, "2021-12-24T13:00:00Z"), ("source_files", 3, "2021-12-26T13:00:00Z")]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_reading_by_convention_without_the_others(spark):
    odd = ["11/1/2020 1:30 AM", "11/1/2020 01:30 ", "3/4/21 10:00", "29-Feb-00 10:00", "2/29/1900 10:00 AM", "12345678901", "99999999", "2021-03-14 02:30 America/New_York", "2021-01-01T10:00+19:00"]
    df = spark.createDataFrame([(v, z) for v in [*INSTANTS, *odd] for z in ("America/Detroit", "No/Where", None)], "v string, z string")
    both = with_instant(with_time_candidates(df, "v", "z", "c"), "v", "z", "i").select("v", "z", "i", by_convention(F.col("c")).alias("w")).collect()
    assert len(both) == 3 * len([*INSTANTS, *odd]) and all(r.i == r.w for r in both) and sum(r.i is not None for r in both) > 60
    df = spark.createDataFrame([(v,) for v in [*DATES, "29-Feb-00", "2/29/1900", "31/12/99"]], "v string")
    both = with_day(with_date_candidates(df, "v", "c"), "v", "i").select("v", "i", by_convention(F.col("c")).alias("w")).collect()
    assert all(r.i == r.w for r in both) and sum(r.i is not None for r in both) > 13


# --- problem 2 ------------------------------------------------------------------------------------

SNAP = "snapshot_no int, source string, citation string, variant string, content_hash string, is_current boolean, _at string, hash string"


def snaps(spark, rows):
    return corpus_changes(spark.createDataFrame([(*r, "x", str(i)) for i, r in enumerate(rows)], SNAP))


def test_problem_2(spark):
    rows = [
        (1, "mcl", "MCL 1.1", "", "AB", True), (1, "mcl", "1.1", None, "ab", True), (1, "mcl", "MCL 1.2", "", None, True), (1, "mcl", "MCL 1.3", "", "cc", True), (1, "mcl", "MCL 1.4", "", "dd", True),
        (1, "mcl", "MCL 1.9", "new", "zz", False), (1, "mre", "MRE 100", "", "aa", True),
        (3, "mcl", "mcl 1.1", "", "ab", True), (3, "mcl", "MCL 1.2", "", "ee", True), (3, "mcl", "MCL 1.4", "", "dd", False), (3, "mcl", "MCL 1.4", "", "d1", True), (3, "mcl", "MCL 1.5", "new", "ff", True),
        (4, "mcl", "MCL 1.2", "", None, True), (4, "mcl", None, None, "q", True), (None, "mcl", "MCL 7.7", "", "q", True),
    ]
    got = sorted(tuple(r) for r in snaps(spark, rows).where("citation is not null").collect())
    assert got == sorted([
        (3, "mcl", "MCL 1.2", "", "changed"), (3, "mcl", "MCL 1.3", "", "removed"), (3, "mcl", "MCL 1.4", "", "changed"), (3, "mcl", "MCL 1.5", "new", "added"),
        (4, "mcl", "MCL 1.1", "", "removed"), (4, "mcl", "MCL 1.2", "", "changed"), (4, "mcl", "MCL 1.4", "", "removed"), (4, "mcl", "MCL 1.5", "new", "removed"),
    ])
    assert [tuple(r) for r in snaps(spark, rows).where("citation is null").collect()] == [(4, "mcl", None, "", "added")]
    assert snaps(spark, []).count() == 0


# --- problem 3 ------------------------------------------------------------------------------------

FILES = "run_id bigint, source string, name string, size bigint, modified string, listing_zone string, sha256 string, state string"
RUNS = "run_id bigint, source string, started_at string, status string, token int"


def brute_taken(files, runs):
    ok = {r[0] for r in runs if (r[3] or "").strip().lower() == "ok"}
    when = {r[0]: r[2] for r in runs}
    out, last = set(), {}
    for run in sorted(ok, key=lambda r: (when[r], r)):
        for f in sorted({x for x in files if x[0] == run}, key=str):
            key, now = (f[1], f[2]), ((f[6] or "").lower() or None, f[3], f[4])
            old = last.get(key)
            diff = old is None or (now[0] != old[0] if now[0] and old[0] else now[1:] != old[1:])
            if diff:
                out.add((run, *key))
            last[key] = now
    return out


def test_problem_3(spark):
    rnd = random.Random(5)
    runs = [(10, "mcl", "2024-01-03T00:00:00Z", "running", 0), (10, "mcl", "2024-01-03T00:00:00Z", " OK ", 0), (11, "mcl", "2024-01-01T00:00:00Z", "ok", 0), (12, "mcl", "2024-01-02T00:00:00Z", "failed", 0),
            (13, "mcl", "2024-01-04T00:00:00Z", None, 0), (14, "mcl", "2024-01-05T00:00:00Z", "Ok", 0), (15, "mre", "2024-01-01T00:00:00Z", "ok", 0)]
    files = [(r[0], r[1], n, rnd.choice([None, 1, 2]), rnd.choice(["2024-01-01T00:00:00Z", "junk", "2024-01-02T00:00:00Z"]), "UTC", rnd.choice([None, "AA", "aa", "bb"]), "x")
             for r in runs for n in ("a", "b", "c", "d", "e") if rnd.random() < 0.8]
    once = list({(f[0], f[1], f[2]): f for f in files}.values())
    got = {tuple(r) for r in taken_in(spark.createDataFrame(once + once[:3], FILES), spark.createDataFrame(runs, RUNS)).collect()}
    assert got == brute_taken(once, runs)
    assert taken_in(spark.createDataFrame([], FILES), spark.createDataFrame([], RUNS)).count() == 0
    led = replay(listings_of(spark.createDataFrame(once, FILES)), run_outcomes(spark.createDataFrame(runs, RUNS)))
    assert led.where("path is null or attempt < 1").count() == 0
    assert led.where("attempt > 1").count() > 0  # leased again after a failed run
    assert {r.run_id for r in led.where("not closed").collect()} <= {12, 13} and {r.run_id for r in led.where("closed").collect()} <= {10, 11, 14, 15}


def test_problem_3_with_nulls(spark):
    runs = [(1, "mcl", None, "ok", 0), (2, "mcl", "2024-01-01T00:00:00Z", "ok", 0), (None, "mcl", "2024-01-01T00:00:00Z", "ok", 0), (3, None, None, None, None)]
    files = [(1, "mcl", "a", None, None, None, None, None), (2, "mcl", "a", None, None, "No/Where", " ", None), (2, "mcl", "b", 1, "x" * 100_000, None, "AA", None), (None, "mcl", "a", 1, None, None, "q", None), (3, None, None, None, None, None, None, None), (9, "mcl", "a", 1, None, None, "z", None)]
    got = {tuple(r) for r in taken_in(spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS)).collect()}
    assert got == {(1, "mcl", "a"), (2, "mcl", "b")}  # a run without a start comes first; null listings are equal


def test_ledger_moves_of_one_item(spark):
    """Leased, expired, leased again, done; unchanged; changed in a failed run only; digests that come and go."""
    at = lambda sha, size=1: (sha, size, 0)
    events = [(1, 10, False, at("x")), (2, 11, True, at("x")), (3, 12, True, at("x")), (4, 13, False, at("y")), (5, 14, True, at("x")), (6, 15, True, at(None)), (7, 16, True, at("z"))]
    df = spark.createDataFrame([(events,)], "e array<struct<token:int,run_id:bigint,ok:boolean,listing:struct<sha:string,size:bigint,modified_at:bigint>>>")
    item = df.select(transitions(F.col("e")).alias("i")).first().i
    assert [(r.run_id, r.token, r.attempt, r.closed) for r in item.log] == [(10, 1, 1, False), (11, 2, 2, True), (13, 4, 1, False)]
    assert (item.state, item.token, item.attempts, item.done.sha) == ("done", 4, 0, "z")


def listing(spark, files):
    return spark.createDataFrame([(n, (s, 1, 0)) for n, s in files.items()], "name string, listing struct<sha:string,size:bigint,modified_at:bigint>")


def test_durable_ledger(spark, tmp_path):
    led = WorkLedger(spark, str(tmp_path))
    names = lambda t: sorted(r["name"] for r in led.work("mcl", t).collect())
    t1 = led.lease("mcl", listing(spark, {"a": "1", "b": "1"}), now=0, ttl=10)
    assert names(t1) == ["a", "b"]
    t2 = led.lease("mcl", listing(spark, {"a": "1", "b": "1", "c": "1"}), now=5, ttl=10)
    assert names(t2) == ["c"]  # the others are still leased, and stay with their holder
    led.complete("mcl", t1, now=6)
    led.complete("mcl", t2, now=6)
    t3 = led.lease("mcl", listing(spark, {"a": "1", "b": "2", "c": "1"}), now=20, ttl=10)
    assert names(t3) == ["b"]
    led.complete("mcl", t3, now=21)
    led.complete("mcl", t3, now=22)  # a retry changes nothing
    t4 = led.lease("mcl", listing(spark, {"a": "1", "b": "3", "c": "1"}), now=30, ttl=1)
    assert names(t4) == ["b"]
    with pytest.raises(StaleWriter):
        led.complete("mcl", t4, now=31)
    t5 = led.lease("mcl", listing(spark, {"a": "1", "b": "3", "c": "1"}), now=32, ttl=10)
    assert names(t5) == ["b"] and led.items("mcl").where("name = 'b'").first().attempts == 2
    with pytest.raises(StaleWriter):
        led.complete("mcl", t4, now=33)  # its item carries a newer token
    led.complete("mcl", t5, now=33)
    assert led.lease("mre", listing(spark, {"a": "1"}), now=34, ttl=10) == 1 and names(t5) == []


def test_commits_are_compared_and_swapped(spark, tmp_path):
    a, b = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    assert a.latest() == (0, None)
    assert a.add(1, {"x": 1}) and not b.add(1, {"x": 2}) and b.latest() == (1, {"x": 1})
    led = WorkLedger(spark, str(tmp_path / "led"))
    rival, once = led.log.add, []

    def add(n, p):  # somebody commits between our read and our commit
        if not once:
            once.append(n)
            WorkLedger(spark, led.folder).lease("mcl", listing(spark, {"z": "1"}), now=0, ttl=10)
        return rival(n, p)

    led.log.add = add
    assert led.lease("mcl", listing(spark, {"a": "1"}), now=0, ttl=10) == 2
    assert sorted((r["name"], r.token) for r in led.items("mcl").collect()) == [("a", 2), ("z", 1)]


# --- problem 4 ------------------------------------------------------------------------------------

XREFS = "xref_id bigint, to_kind string, to_key string, found_at timestamp_ntz, born int"
DOCS = "source string, citation string, variant string, first_seen string, removed_at string, kind string"
PACTS = "act_citation string, recorded_at string, key string"


def orphan_tables(spark):
    at = lambda d: datetime(2024, 1, d)
    x = [(1, "mcl", "MCL 1.1", at(5), 0), (1, "mcl", "MCL 1.1", at(5), 0), (2, "MCL ", "mcl 1.2(3)", at(5), 0), (3, "Public-Act", "act 5 of 1999", at(5), 0), (4, "public_act", "1999  pa  6", at(5), 0),
         (5, "mcl", "MCL 9.9", at(5), 0), (6, "mcl", None, at(5), 0), (7, "mcl", "MCL 1.1", at(20), 0), (8, "mcl", "MCL 1.4", at(5), 0), (9, "mre", "MRE 100", at(5), 0), (10, "mcl", "", at(5), 0)]
    d = [("mcl", "MCL 1.1", "", "2024-01-01T00:00:00Z", "2024-01-20T00:00:00Z", "k"), ("mcl", "MCL 1.2", None, "2024-02-06T00:00:00Z", None, "k"), ("mcl", "MCL 1.4", "new", "2024-01-01T00:00:00Z", None, "k"), (None, None, None, None, None, None)]
    a = [("1999 PA 5", "2024-01-01T00:00:00Z", "k"), ("1999 PA 5", "2024-01-01T00:00:00Z", "k"), ("1999 PA 6", "2024-03-06T00:00:00Z", "k")]
    return spark.createDataFrame(x, XREFS), spark.createDataFrame(d, DOCS), spark.createDataFrame(a, PACTS)


def test_problem_4(spark):
    got = {(r.xref_id, r.to_table, r.period, r.reason) for r in orphan_references(*orphan_tables(spark)).collect()}
    assert got == {
        (2, "documents", "2024-01", "later"), (4, "public_acts", "2024-01", "later"), (5, "documents", "2024-01", "missing"), (7, "documents", "2024-01", "deleted"),
        (8, "documents", "2024-01", "missing"), (9, "documents", "2024-01", "missing"), (10, "documents", "2024-01", "missing"),
    }
    x, d, a = orphan_tables(spark)
    assert orphan_references(x.limit(0), d, a).count() == 0
    assert orphan_references(x, d.limit(0), a.limit(0)).where("reason <> 'missing'").count() == 0


def test_problem_4_with_nulls_long_keys_and_clashing_columns(spark):
    """A reference without a time waits if its parent is unknown and is no case otherwise; columns named like the state's are ignored."""
    at = datetime(2024, 1, 5)
    x = [(None, None, "MCL 1.1", None, 1, True, "k"), (1, "mcl", "MCL 1.1", None, 1, True, "k"), (2, "mcl", "MCL 9.9", None, 1, True, None), (3, "mcl", "x" * 100_000, at, 1, True, "k"), (None, "mcl", "MCL 9.9", at, 1, True, "k"), (None, "mcl", "MCL 9.9", at, 2, None, "k")]
    refs = spark.createDataFrame(x, "xref_id bigint, to_kind string, to_key string, found_at timestamp_ntz, t bigint, dead boolean, batch string")
    d = spark.createDataFrame([("mcl", "MCL 1.1", "", None, None, "k"), ("mcl", "MCL 1.2", "", "junk", "2024-01-01T00:00:00Z", "k"), (None, None, None, None, None, None)], DOCS)
    a = spark.createDataFrame([(None, None, None)], PACTS)
    got = sorted(((r.xref_id, r.to_table, r.period, r.reason) for r in orphan_references(refs, d, a).collect()), key=str)
    assert got == [(2, "documents", None, "missing"), (3, "documents", "2024-01", "missing"), (None, "documents", "2024-01", "missing"), (None, "documents", None, "missing")]
    late = spark.createDataFrame([(1, "mcl", "MCL 1.2", datetime(2023, 1, 1), 0), (2, "mcl", "MCL 1.2", at, 0)], XREFS)
    assert [(r.xref_id, r.reason) for r in orphan_references(late, d, a).collect()] == [(2, "deleted")]  # no date of arrival: always there until removed


def test_orphan_state_does_not_depend_on_its_batches(spark):
    tables = orphan_tables(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    whole, monthly = (orphan_state(*tables, months=m) for m in (1200, 1))
    assert monthly.batches > whole.batches
    assert rows(whole.orphans()) == rows(monthly.orphans()) and rows(whole.snapshot_counts()) == rows(monthly.snapshot_counts())
    assert rows(whole.references()) == rows(monthly.references())
    counts = {(r.period, r.to_table, r.reason): r.open_orphans for r in monthly.snapshot_counts().collect()}
    assert counts["2024-01", "documents", "missing"] == 4 and counts["2024-03", "documents", "missing"] == 4  # months without a move too
    assert (counts["2024-01", "documents", "later"], counts["2024-02", "documents", "later"]) == (1, 0)
    assert (counts["2024-02", "public_acts", "later"], counts["2024-03", "public_acts", "later"]) == (1, 0)
    assert counts["2024-01", "documents", "deleted"] == 2  # the one found then and the one found before
    for months in (1, 1200):
        assert {r.xref_id for r in orphan_references(*tables, months=months).collect()} == {2, 4, 5, 7, 8, 9, 10}


def brute_orphans(refs, events):
    """Every reference against all events of its parent: what it met, and all months' open orphans."""
    out, moves = [], {}
    for x, key, found in refs:
        life = sorted({(t, dead) for k, t, dead in events if k == key})
        met = [e for e in life if e[0] <= found]
        if not life:
            spells = [(found, None, "missing")]
        elif not met and not life[0][1]:
            spells = [(found, life[0][0], "later")]
        else:
            spells = [(found, None, "deleted")] if met and met[-1][1] else []
        if spells:
            out.append((x, spells[0][2]))
        dead = bool(met and met[-1][1])
        for t, d in [e for e in life if e[0] > found][1 if spells and spells[0][2] == "later" else 0 :]:
            if d != dead:
                moves[t, "deleted"] = moves.get((t, "deleted"), 0) + (1 if d else -1)
            dead = d
        for a, b, r in spells:
            moves[a, r] = moves.get((a, r), 0) + 1
            if b is not None:
                moves[b, r] = moves.get((b, r), 0) - 1
    return sorted(out), moves


@pytest.mark.parametrize("seed", [1, 2])
def test_orphan_state_against_brute_force(spark, seed):
    from legis_engine.operators.orphans import replay

    rnd = random.Random(seed)
    day = 86_400
    keys = ["a", "b", "c", "d", "hot"]
    events = [(k, rnd.randrange(0, 300) * day, rnd.random() < 0.4) for k in keys[1:] for _ in range(rnd.randint(0, 5))]
    refs = [(i, rnd.choice([*keys, "hot", "hot"]), rnd.randrange(0, 300) * day) for i in range(60)]
    want, moves = brute_orphans(refs, events)
    r = spark.createDataFrame([(i, "documents", "mcl", k, t) for i, k, t in refs + refs[:5]], "xref_id bigint, to_table string, kind string, key string, found bigint")
    e = spark.createDataFrame([("documents", "mcl", k, t, d) for k, t, d in events + events[:2]], "to_table string, kind string, key string, t bigint, dead boolean")
    state = replay(r, e, months=2)
    assert sorted((x.xref_id, x.reason) for x in state.orphans().collect()) == want
    last = {x.reason: x.open_orphans for x in state.snapshot_counts().orderBy("period").collect()}
    assert last == {k: sum(d for (_, kk), d in moves.items() if kk == k) for k in {k for _, k in moves}}


def test_orphan_state_parent_that_arrives_again(spark):
    key, none = ("documents", "mcl", "MCL 1.1"), "to_table string, kind string, key string, "
    refs = lambda *rows: spark.createDataFrame([(i, *key, t) for i, t in rows], f"xref_id bigint, {none}found bigint")
    came = lambda *ts: [(*key, -(1 << 62) if t is None else t, False) for t in ts]
    gone = lambda *ts: [(*key, t, True) for t in ts]
    news = lambda a, b: spark.createDataFrame(a + b, f"{none}t bigint, dead boolean")
    is_open = lambda s: [r.open for r in s.references().orderBy("xref_id").collect()]
    s = OrphanState.empty(spark).step(refs((1, 5)), news(came(10), gone()))
    assert is_open(s) == [False]
    s = s.step(refs(), news(came(), gone(20, 20)))
    assert is_open(s) == [True]
    s = s.step(refs((2, 31)), news(came(30), gone()))
    assert is_open(s) == [False, False]
    s = s.step(refs(), news(came(10), gone(20)))  # delivered again: changes nothing
    assert is_open(s) == [False, False]
    assert is_open(s.step(refs(), news(came(50), gone(40)))) == [False, False]
    assert is_open(s.step(refs(), news(came(40), gone(40)))) == [True, True]
    assert is_open(OrphanState.empty(spark).step(refs((1, 5)), news(came(), gone(20))).step(refs(), news(came(10), gone()))) == [True]
    assert is_open(OrphanState.empty(spark).step(refs((1, 5)), news(came(None), gone()))) == [False]
    again = OrphanState(s.spark, s.folder, 1).step(refs(), news(came(), gone(20, 20)))  # a batch repeated after a failure
    assert is_open(again) == [True]


# --- problem 5 ------------------------------------------------------------------------------------

VERS = "document_id bigint, first_seen string, content_hash string, status string, valid_from string, _hot string"


def vers(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VERS)


def brute_history(rows):
    out = []
    for doc in {r[0] for r in rows}:
        seen = sorted({(r[1], (r[2] or "").lower(), (r[3] or "").strip().lower().rstrip(".")) for r in rows if r[0] == doc and r[1]})
        starts = [s for i, s in enumerate(seen) if i == 0 or s[1:] != seen[i - 1][1:]]
        out += [(doc, s[0], starts[i + 1][0] if i + 1 < len(starts) else "", s[2]) for i, s in enumerate(starts)]
    return sorted(out)


@pytest.mark.parametrize("hot", [200_000, 3])
def test_problem_5(spark, hot):
    rnd = random.Random(7)
    rows = [(d, f"2024-{m:02d}-{k:02d}T00:00:00Z", rnd.choice(["aa", "AA", "bb"]), rnd.choice(["active", " Active.", "repealed"])) for d in (1, 2, 3) for m in range(1, 6) for k in range(1, rnd.randint(2, 6))]
    rows += rows[:5] + [(4, "2024-01-01T00:00:00Z", "aa", "active"), (4, None, "bb", "active")]
    got = sorted(tuple(r) for r in document_history(vers(spark, rows), hot).collect())
    assert got == brute_history(rows)


def test_problem_5_nulls_and_empty(spark):
    rows = [(1, "2024-01-01T00:00:00Z", None, None), (1, "2024-01-02T00:00:00Z", None, None), (1, "2024-01-03T00:00:00Z", "aa", None), (None, "2024-01-01T00:00:00Z", "aa", "active")]
    got = {tuple(r) for r in document_history(vers(spark, rows)).collect()}
    assert got == {(1, "2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z", None), (1, "2024-01-03T00:00:00Z", "", None), (None, "2024-01-01T00:00:00Z", "", "active")}
    assert document_history(vers(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [200_000, 2])
def test_problem_5_two_states_at_one_instant(spark, hot):
    rows = [(1, "2024-01-01", "aa", "x"), (1, "2024-01-01", "bb", "y"), (1, "2024-01-02", "bb", "x"), (1, "2024-02-03", "cc", "x"), (2, "2024-01-01", "aa", "y"), (2, "2024-01-01", "bb", "x"), (2, "2024-03-01", "bb", "x")]
    got = sorted(tuple(r) for r in document_history(vers(spark, rows), hot).collect())
    assert got == brute_history(rows)
    assert (1, "2024-01-01", "2024-01-01", "x") in got and (1, "2024-02-03", "", "x") in got


def test_satellites_only_take_insertions(spark):
    see = lambda rows: mark_hot(vers(spark, rows).drop("_hot"), "document_id")
    first = [(1, "2024-01-01", "aa", "x"), (1, "2024-01-02", "aa", "x"), (1, "2024-01-03", "bb", "x")]
    sat = build_satellite(see(first), "document_id", "first_seen", ["content_hash"])
    assert [(r.first_seen, r.content_hash) for r in sat.orderBy("first_seen").collect()] == [("2024-01-01", "aa"), ("2024-01-03", "bb")]
    more = [(1, "2024-01-04", "bb", "x"), (1, "2024-01-05", "aa", "x"), (2, "2024-01-01", "aa", "x")]
    add = build_satellite(see(more), "document_id", "first_seen", ["content_hash"], after=sat, log=see(first))
    assert sorted((r.document_id, r.first_seen) for r in add.collect()) == [(1, "2024-01-05"), (2, "2024-01-01")]
    with pytest.raises(ValueError):
        build_satellite(see(more), "document_id", "first_seen", ["content_hash"], after=sat)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_satellites_with_late_rows_equal_those_built_at_once(spark, seed):
    """Observations in batches of any order: the same history, and nothing inserted is ever taken back."""
    rnd = random.Random(seed)
    rows = [(d, f"2024-0{rnd.randint(1, 6)}-{rnd.randint(1, 9):02d}", rnd.choice("abc"), rnd.choice("xy")) for d in (1, 2) for _ in range(14)]
    see = lambda part: mark_hot(vers(spark, part).drop("_hot"), "document_id", 5)
    attrs, tie = {"content": ["content_hash"], "state": ["status"]}, ["content_hash", "status"]
    sats, seen = {}, []
    for part in (rows[::3], rows[1::3], rows[2::3]):
        for n, a in attrs.items():
            old = sats.get(n)
            new = build_satellite(see(part), "document_id", "first_seen", a, tie, old, see(seen) if old is not None else None)
            sats[n] = old.unionByName(new) if old is not None else new
            sats[n] = spark.createDataFrame(sats[n].collect(), sats[n].schema)
        seen += part
    hot = {n: mark_hot(s.drop("_hot"), "document_id", 5) for n, s in sats.items()}
    view = history_view(hot, "document_id", "first_seen", attrs, tie)
    assert sorted((r.document_id, r.valid_from, r.valid_to or "", r.status) for r in view.collect()) == brute_history(rows)
