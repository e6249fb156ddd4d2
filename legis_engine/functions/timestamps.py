"""All readings of a date or time written in mixed forms, as column expressions.

A value is first split into fields by one regular expression per written form; the fields then
give an array of candidate readings. A candidate records which written form it assumes and how
many of the stated conventions it breaks (0: the reading the conventions ask for).

Conventions: slashed dates are month/day/year; two-digit years are 20yy; an offset or zone in
the value wins; abbreviations are fixed offsets; a wall time that occurs twice is the first
occurrence; a skipped one is read with the offset before the change. Bare digits are Unix
seconds if there are 9 to 11, milliseconds if there are 12 or 13; fewer or more have no reading
(8 are a date, 14 may be a date and time run together).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Abbreviations with their fixed offsets in seconds.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000}

_SEP = "\x01"
_MON = (
    "JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|"
    "SEP(?:T(?:EMBER)?)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?"
)
_DAY = "(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*"
_YEAR = "([0-9]{4}|[0-9]{2})"
_ZONE = r"(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{2,4}|[A-Z]+(?:[/_-][A-Z]+)+))?"
_SEC = r"(?::([0-9]{2})(?:[.,][0-9]+)?)?"
_AMPM = r"(?: ?([AP])\.?M\.?(?![A-Z]))?"
_CLOCK = rf"([0-9]{{1,2}}):([0-9]{{2}}){_SEC}{_AMPM}{_ZONE}"

# Written form -> (pattern over the collapsed value in upper case, replacement giving the fields
# year, month, day, hour, minute, second, am/pm, zone).
_TIMES = {
    "iso": (rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:T|,? ){_CLOCK}$", "1 2 3 4 5 6 7 8"),
    "basic": (rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[T ]([0-9]{{2}}):?([0-9]{{2}})(?::?([0-9]{{2}})(?:[.,][0-9]+)?)?{_ZONE}$", "1 2 3 4 5 6 - 7"),
    "day_month": (rf"^(?:{_DAY},? )?([0-9]{{1,2}})[ -]({_MON})\.?[ -]{_YEAR},? {_CLOCK}$", "3 2 1 4 5 6 7 8"),
    "month_day": (rf"^(?:{_DAY},? )?({_MON})\.? ?([0-9]{{1,2}})(?:ST|ND|RD|TH)?(?:, ?| ){_YEAR},? (?:AT )?{_CLOCK}$", "3 1 2 4 5 6 7 8"),
    "slashed": (rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/{_YEAR},? {_CLOCK}$", "3 1 2 4 5 6 7 8"),
}
_OFDAY = (
    r"(?:,? ?(?:AT )?(?:NOON|MIDNIGHT|[0-9]{1,2}(?::[0-9]{2}){0,2}(?:[.,][0-9]+)?(?: ?[AP]\.? ?M\.?)?)"
    r"(?: ?(?:[A-Z]{1,4}|[+-][0-9]{2}:?[0-9]{2}|[A-Z]+(?:[/_-][A-Z]+)+))?)?\.?$"
)
_DATES = {
    "iso": (rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:T[0-9].*$|{_OFDAY})", "1 2 3"),
    "digits": (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "1 2 3"),
    "day_month": (rf"^(?:{_DAY},? )?([0-9]{{1,2}})[ -]({_MON})\.?[ ,-] ?{_YEAR}{_OFDAY}", "3 2 1"),
    "month_day": (rf"^(?:{_DAY},? )?({_MON})\.? ?([0-9]{{1,2}})(?:ST|ND|RD|TH)?(?:, ?| ){_YEAR}{_OFDAY}", "3 1 2"),
    "day_of": (rf"^(?:THE )?([0-9]{{1,2}})(?:ST|ND|RD|TH)? DAY OF ({_MON})\.?,? ?(?:IN THE YEAR )?{_YEAR}{_OFDAY}", "3 2 1"),
    "slashed": (rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/{_YEAR}{_OFDAY}", "3 1 2"),
}
TIME_FORMS = ["iso", "basic", "day_month", "month_day", "slashed", "seconds", "millis"]
DATE_FORMS = ["iso", "digits", "day_month", "month_day", "day_of", "slashed"]

CANDIDATE = "array<struct<form:int,at:bigint,breaks:int>>"


def clean(c: Column) -> Column:
    """White space collapsed and trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r"(?U)[\s\x{1C}-\x{1F}\x{200B}\x{FEFF}]+", " ")))


def _fields(v: Column, forms: dict[str, tuple[str, str]], names: list[str]) -> Column:
    """Array of field strings by the one form that matches (first: its number), else null."""
    out = None
    for name, (pattern, order) in forms.items():
        got = _SEP.join([str(names.index(name)), *[f"${x}" if x != "-" else "" for x in order.split()]])
        got = F.when(v.rlike(pattern), F.split(F.regexp_replace(v, pattern, got.replace(_SEP, "\x01")), _SEP))
        out = got if out is None else F.coalesce(out, got)
    return out


def _month(token: Column) -> Column:
    named = F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.substring(token, 1, 3))
    return F.when(token.rlike("^[0-9]+$"), token.cast("int")).when(
        token.rlike("^[A-Z]{3}") & ((named % 3) == 1), ((named + 2) / 3).cast("int")
    )


@functools.lru_cache(maxsize=1)
def _zone_ids(spark: SparkSession) -> str:
    jvm = spark._jvm
    return str(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()))


def with_zone(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` plus ``out``: the tz database name a text means in any letter case, or null.

    Joined to the list of all such names: some 600 rows whatever the data, so it is broadcast.
    """
    names = df.sparkSession.range(1, numPartitions=1).select(F.explode(F.split(F.lit(_zone_ids(df.sparkSession)), ",")).alias(out))
    names = names.groupBy(F.upper(out).alias("_zk")).agg(F.min(out).alias(out))
    return df.join(F.broadcast(names), F.upper(F.trim(text)) == F.col("_zk"), "left").drop("_zk")


def _offset_seconds(z: Column) -> Column:
    """Fixed offset of a zone token: a number or a known abbreviation, else null."""
    part = lambda g: F.regexp_extract(z, r"^([+-])([0-9]{2}):?([0-9]{2})$", g)
    amount = part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60
    numeric = F.when((part(2).try_cast("int") <= 18) & (part(3).try_cast("int") < 60), F.when(part(1) == "-", -amount).otherwise(amount))
    named = None
    for k, v in ABBREVIATIONS.items():
        named = F.when(z == k, v) if named is None else named.when(z == k, v)
    return F.when(z.rlike("^[+-]"), numeric).otherwise(named)


def _seconds_of(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970 of a wall time taken as UTC, null if the date or time cannot exist."""
    date = F.expr("date'1970-01-01'")
    month_ok = (month >= 1) & (month <= 12) & (day >= 1) & (year >= 1)
    first = F.try_make_timestamp_ntz(year, F.when(month_ok, month), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    last = F.dayofmonth(F.last_day(first))
    days = F.when(day <= last, F.datediff(F.date_add(first, day - 1), date))
    return F.when(
        (hour >= 0) & (hour < 24) & (minute >= 0) & (minute < 60) & (second >= 0) & (second < 60),
        days.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second,
    )


def zone_shift(wall: Column, zone: Column) -> Column:
    """UTC seconds of a wall time (seconds as if UTC) in a tz database zone.

    A repeated wall time is its first occurrence, a skipped one has the offset before the change;
    both are what the platform's zone rules do.
    """
    as_ntz = F.timestamp_add("SECOND", wall, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    utc = F.convert_timezone(zone, F.lit("UTC"), as_ntz)
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), utc)


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _wall_of(utc: Column, zone: Column) -> Column:
    there = F.convert_timezone(F.lit("UTC"), zone, F.timestamp_add("SECOND", utc, F.expr(_EPOCH)))
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), there)


def _candidate(form: Column, at: Column, breaks: int) -> Column:
    return F.struct(form.cast("int").alias("form"), at.alias("at"), F.lit(breaks).alias("breaks"))


def _real(*candidates: Column) -> Column:
    return F.filter(F.array(*candidates), lambda c: c["at"].isNotNull()).cast(CANDIDATE)


def _time_parts(df: DataFrame, value: str, zone: str) -> DataFrame:
    """``df`` plus the fields of ``value`` and what they are read with: ``_fixed`` or ``_zone``, ``_digits`` if they are bare.

    Worked out in stages so that no step is repeated.
    """
    num = lambda i: F.get("_f", i).try_cast("int")
    d = df.withColumn("_v", clean(F.col(value)))
    d = d.withColumn("_f", _fields(F.col("_v"), _TIMES, TIME_FORMS))
    d = d.withColumns({"_form": num(0), "_y": num(1), "_short": F.length(F.get("_f", 1)) == 2, "_m": _month(F.get("_f", 2)), "_d": num(3),
                       "_h": num(4), "_mi": num(5), "_s": F.when(F.get("_f", 6) == "", 0).otherwise(num(6)), "_ap": F.get("_f", 7), "_z": F.get("_f", 8),
                       "_digits": F.when(F.col("_v").rlike("^[0-9]{9,13}$"), F.col("_v").try_cast("bigint"))})
    d = with_zone(with_zone(d, F.col("_z"), "_region"), F.col(zone), "_own")
    stated = F.coalesce(F.col("_z") != "", F.lit(False))
    hour12 = F.when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "P", 12).otherwise(0))
    d = d.withColumns({
        "_hour": F.when(F.col("_ap") != "", hour12).otherwise(F.col("_h")),
        "_fixed": F.when(stated, _offset_seconds(F.col("_z"))),
        "_year": F.when(F.col("_short"), F.col("_y") + 2000).otherwise(F.col("_y")),
    })
    return d.withColumn("_zone", F.when(stated & F.col("_fixed").isNull(), F.when(F.col("_z").contains("/"), F.col("_region"))).when(~stated, F.coalesce("_own", F.lit("UTC"))))


def _utc(w: str) -> Column:
    """UTC seconds of the wall time ``w`` of ``_time_parts``."""
    return F.when(F.col("_fixed").isNotNull(), F.col(w) - F.col("_fixed")).when(
        F.col("_zone") == "UTC", F.col(w)).when(F.col("_zone").isNotNull() & F.col(w).isNotNull(), zone_shift(F.col(w), F.col("_zone")))


def with_instant(df: DataFrame, value: str, zone: str, out: str) -> DataFrame:
    """``df`` plus ``out``: ``by_convention`` of ``with_time_candidates``, without working out the readings that break a convention."""
    keep = df.columns
    d = _time_parts(df, value, zone)
    d = d.withColumn("_w0", _seconds_of(*(F.col(c) for c in ("_year", "_m", "_d", "_hour", "_mi", "_s"))))
    bare = F.when(F.length("_v") <= 11, F.col("_digits")).otherwise(F.floor(F.col("_digits") / 1000).cast("bigint"))
    return d.select(*keep, F.when(F.col("_f").isNotNull(), _utc("_w0")).otherwise(bare).alias(out))


def with_time_candidates(df: DataFrame, value: str, zone: str, out: str) -> DataFrame:
    """``df`` plus ``out``: every reading of ``value`` as an instant.

    ``zone`` names the column with the zone of values that state none. ``out`` is an array of
    ``struct(form, at, breaks)``, at in seconds since 1970 UTC, empty if there is no reading.
    A null or unknown zone counts as UTC.
    """
    keep = df.columns
    d = _time_parts(df, value, zone)
    clock = (F.col("_hour"), F.col("_mi"), F.col("_s"))
    slashed = F.col("_form") == TIME_FORMS.index("slashed")
    d = d.withColumns({
        "_w0": _seconds_of(F.col("_year"), F.col("_m"), F.col("_d"), *clock),
        "_w1": _seconds_of(F.when(F.col("_short"), F.col("_y") + 1900), F.col("_m"), F.col("_d"), *clock),
        "_w2": _seconds_of(F.when(slashed & (F.col("_m") != F.col("_d")), F.col("_year")), F.col("_d"), F.col("_m"), *clock),
    })
    d = d.withColumns({"_u0": _utc("_w0"), "_u1": _utc("_w1"), "_u2": _utc("_w2")})
    # The same wall time an hour of real time later: only where the clock was set back.
    later = F.col("_u0") + 3600
    zoned = F.col("_fixed").isNull() & F.col("_zone").isNotNull() & (F.col("_zone") != "UTC") & F.col("_u0").isNotNull()
    d = d.withColumn("_again", F.when(zoned, F.when(_wall_of(later, F.col("_zone")) == F.col("_w0"), later)))
    short = F.length("_v") <= 11  # seconds up to 11 digits, beyond that milliseconds
    form = F.col("_form")
    return d.select(
        *keep,
        F.when(F.col("_f").isNotNull(), _real(_candidate(form, F.col("_u0"), 0), _candidate(form, F.col("_again"), 1), _candidate(form, F.col("_u1"), 1), _candidate(form, F.col("_u2"), 1)))
        .when(F.col("_digits").isNotNull(), _real(
            _candidate(F.lit(TIME_FORMS.index("seconds")), F.when(short, F.col("_digits")), 0),
            _candidate(F.lit(TIME_FORMS.index("millis")), F.when(~short, F.floor(F.col("_digits") / 1000).cast("bigint")), 0)))
        .otherwise(F.array().cast(CANDIDATE)).alias(out),
    )


def _date_parts(df: DataFrame, value: str) -> DataFrame:
    """``df`` plus the fields of ``value`` as a date."""
    num = lambda i: F.get("_f", i).try_cast("int")
    d = df.withColumn("_v", clean(F.col(value)))
    d = d.withColumn("_f", _fields(F.col("_v"), _DATES, DATE_FORMS))
    d = d.withColumns({"_form": num(0), "_y": num(1), "_short": F.length(F.get("_f", 1)) == 2, "_m": _month(F.get("_f", 2)), "_d": num(3)})
    return d.withColumn("_year", F.when(F.col("_short"), F.col("_y") + 2000).otherwise(F.col("_y")))


def with_day(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` plus ``out``: ``by_convention`` of ``with_date_candidates``, without working out the readings that break a convention."""
    day = _seconds_of(F.col("_year"), F.col("_m"), F.col("_d"), F.lit(0), F.lit(0), F.lit(0))
    return _date_parts(df, value).select(*df.columns, day.alias(out))


def with_date_candidates(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` plus ``out``: every reading of ``value`` as a calendar date (at: UTC midnight)."""
    keep = df.columns
    d = _date_parts(df, value)
    zero = (F.lit(0), F.lit(0), F.lit(0))
    slashed = F.col("_form") == DATE_FORMS.index("slashed")
    d = d.withColumns({
        "_w0": _seconds_of(F.col("_year"), F.col("_m"), F.col("_d"), *zero),
        "_w1": _seconds_of(F.when(F.col("_short"), F.col("_y") + 1900), F.col("_m"), F.col("_d"), *zero),
        "_w2": _seconds_of(F.when(slashed & (F.col("_m") != F.col("_d")), F.col("_year")), F.col("_d"), F.col("_m"), *zero),
    })
    form = F.col("_form")
    real = _real(_candidate(form, F.col("_w0"), 0), _candidate(form, F.col("_w1"), 1), _candidate(form, F.col("_w2"), 1))
    return d.select(*keep, F.when(F.col("_f").isNotNull(), real).otherwise(F.array().cast(CANDIDATE)).alias(out))


def by_convention(candidates: Column) -> Column:
    """Instant of the reading that breaks no convention, null if there is none."""
    return F.get(F.filter(candidates, lambda c: c["breaks"] == 0), 0)["at"]


def iso_instant(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` whatever the session's zone."""
    ntz = F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_date(seconds: Column) -> Column:
    return F.substring(iso_instant(seconds), 1, 10)
