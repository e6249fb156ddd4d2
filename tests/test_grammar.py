"""Citations, references, ranges and history strings."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from legis_engine.functions.citations import citation_struct, normalize_act, normalize_citation, roman_to_int, sort_key
from legis_engine.functions.history import parse_history
from legis_engine.functions.xrefs import extract_xrefs, narrative_ranges, references_in, stub_range
from legis_engine.operators.bills import with_targets


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def many(spark, column, values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v")).alias("x")).collect()]


CASES = {
    "mcl 750.520B(1)(a)": "MCL 750.520b", "750.83": "MCL 750.83", "MCL767a.1": "MCL 767A.1", "MCL 12a.345B et seq.": "MCL 12A.345b", "  MCL   1.1 ": "MCL 1.1",
    "MCR 2.116(C)": "MCR 2.116", "MCR 2.116A": "MCR 2.116A", "mcr 2.116a": "MCR 2.116A", "Mcr  44.741c(B)(1)": "MCR 44.741C", "mre 404": "MRE 404", "Const. 1963, Art. IV, § 5": "Const 1963, art 4, § 5", "1963 Const, art 12, § 3A": "Const 1963, art 12, § 3a",
    "Const 1963, Schedule, § 2": "Const 1963, Schedule, § 2", "0.02": None, "MCL 000.5": None, "": None, "act 5": None, "MCL 1234.5": None, "MRE 12": None, None: None,
}


def test_normalize(spark):
    assert dict(zip(CASES, many(spark, normalize_citation, list(CASES)), strict=True)) == CASES
    assert one(spark, citation_struct, "MRE 404").source == "mre"
    acts = {"1931 pa 328": "1931 PA 328", "Act No. 287 of the Public Acts of 1964": "1964 PA 287", "Act 7 of 1999": "1999 PA 7", "x": None, None: None}
    assert dict(zip(acts, many(spark, normalize_act, list(acts)), strict=True)) == acts


def test_roman_and_order(spark):
    assert many(spark, roman_to_int, ["I", "IV", "IX", "XIV", "XL", "xc", "CXLIV"]) == [1, 4, 9, 14, 40, 90, 144]
    want = ["MCL 750.9", "MCL 750.10", "MCL 750.10a", "MCL 750.83", "MCL 767.96", "MCL 767A.1", "MCL 768.1"]
    df = spark.createDataFrame([(c,) for c in reversed(want)], "c string")
    assert [r.c for r in df.orderBy(sort_key(F.col("c"))).collect()] == want
    const = ["Const 1963, art 1, § 2", "Const 1963, art 12, § 1", "Const 1963, Schedule, § 1"]
    assert [r.c for r in spark.createDataFrame([(c,) for c in reversed(const)], "c string").orderBy(sort_key(F.col("c"))).collect()] == const


def refs(spark, text):
    return [(r.kind, r.key, r.in_range) for r in one(spark, references_in, text)]


def test_references(spark):
    assert refs(spark, "MCL 750.83, 750.84, and 750.85 apply") == [("mcl", f"MCL 750.{n}", False) for n in (83, 84, 85)]
    assert refs(spark, "see MCL 760.1 to 777.69 and MCL 3.1041 & 3.1042") == [
        ("mcl", "MCL 760.1", True), ("mcl", "MCL 777.69", True), ("mcl", "MCL 3.1041", False), ("mcl", "MCL 3.1042", False)]
    assert refs(spark, "MCL 460.1 – 460.11, 0.02 grams") == [("mcl", "MCL 460.1", True), ("mcl", "MCL 460.11", True)]
    assert refs(spark, "MCL 1.1(2)(a) or 1.2(b) - more") == [("mcl", "MCL 1.1", False), ("mcl", "MCL 1.2", False)]
    assert refs(spark, "being sections 750.1 to 750.3 of the Michigan Compiled Laws") == [("mcl", "MCL 750.1", True), ("mcl", "MCL 750.3", True)]
    assert refs(spark, "being section 750.1 of another code") == []
    assert refs(spark, "1931 PA 328; Act No. 5 of the Public Acts of 1999; MCR 2.116 and MRE 404; Const 1963, art IV, § 5") == [
        ("public_act", "1931 PA 328", False), ("public_act", "1999 PA 5", False), ("mcr", "MCR 2.116", False), ("mre", "MRE 404", False), ("const", "Const 1963, art 4, § 5", False)]
    assert refs(spark, "under MCR 2.116A and MCR 2.116a") == [("mcr", "MCR 2.116A", False)] * 2
    assert refs(spark, None) == refs(spark, "") == []


def test_references_are_distinct_and_not_to_self(spark):
    df = spark.createDataFrame([(1, "MCL 1.1, MCL 1.2 and MCL 1.1 again", "MCL 1.2")], "id int, t string, own string")
    assert [(r.seq, r.key) for r in extract_xrefs(df, "id", "t", "own").orderBy("seq").collect()] == [(0, "MCL 1.1")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 999), st.integers(1, 99999), st.sampled_from(["", "a", "zz"]), st.sampled_from([", ", ", and ", " & ", " or ", " to ", "-"])), min_size=1, max_size=30))
def test_rendered_chains_come_back(spark, items):
    text = "MCL " + "".join(f"{c}.{n}{s}{sep if i + 1 < len(items) else ''}" for i, (c, n, s, sep) in enumerate(items)) + ", or 0.08 more"
    assert [k for _, k, _ in refs(spark, text)] == [f"MCL {c}.{n}{s}" for c, n, s, _ in items]


def test_ranges(spark):
    df = spark.createDataFrame([("Act 5, being sections 333.13601 to 333.13606 of the Michigan Compiled Laws, are repealed effective 1993.",
                                 "Former MCL 750.85, which pertained to x, was repealed by Act 266.\nFormer MCL 333.1-333.9 Expired. 1981")], "t string, n string")
    got = df.select(F.inline(narrative_ranges(F.col("t"), F.col("n")))).collect()
    assert [(r.start_citation, r.end_citation, r.status, r.chapter) for r in got] == [
        ("MCL 333.13601", "MCL 333.13606", "repealed", "333"), ("MCL 750.85", "MCL 750.85", "repealed", "750"), ("MCL 333.1", "MCL 333.9", "expired", "333")]
    s = one(spark, stub_range, "131.1-139.3 Repealed. 1943, Act 202.")
    assert (s.start_citation, s.end_citation, s.status) == ("MCL 131.1", "MCL 139.3", "repealed")
    assert one(spark, stub_range, "An act to repeal 131.1") is None


def test_history(spark):
    got = one(spark, parse_history, "1931, Act 328, Eff. Sept. 18, 1931 ;-- Am. 1994, Act 127, Imd. Eff. June 3, 1994 ;-- 1999, Act 1, Eff. upon vote;--nonsense")
    assert [(r.kind, r.act_citation, r.immediate_effect, r.effective_date, r.effective_raw) for r in got] == [
        ("enacted", "1931 PA 328", False, "1931-09-18", "Sept. 18, 1931"), ("amended", "1994 PA 127", True, "1994-06-03", "June 3, 1994"),
        ("other", "1999 PA 1", False, None, "upon vote"), ("other", None, False, None, None)]
    assert one(spark, parse_history, "Add. 1999, Act 1, Eff. Feb. 30, 1999")[0].effective_date is None
    assert one(spark, parse_history, None) == []


def test_bill_targets(spark):
    df = spark.createDataFrame([("Crimes; amends MCL 750.1 to 750.5 & 750.9 and adds MCL 3.1 et seq. to 1931 PA 328. Creates new act.",), ("Nothing",)], "description string")
    a, b = with_targets(df).collect()
    assert (a.sections, [tuple(s) for s in a.spans], a.acts, a.creates_new_act) == (["MCL 750.9"], [("MCL 750.1", "MCL 750.5"), ("MCL 3.1", None)], ["1931 PA 328"], True)
    assert (b.sections, b.spans, b.acts, b.creates_new_act) == ([], [], [], False)
