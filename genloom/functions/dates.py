"""Date and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ymd(d: Column) -> Column:
    return F.struct(F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"))


def in_range(d: Column) -> Column:
    """Whether the year is from 1400 to 10000, as calendar dates are limited here."""
    return F.year(d).between(1400, 10000)


def weekday(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def shift_months(d: Column, n: int) -> Column:
    return F.add_months(d, n)


def periods_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open periods."""
    return (a0 < b1) & (b0 < a1)


def iterate(first: Column, last: Column, step: str) -> Column:
    """Every step from first to last."""
    return F.sequence(first, last, F.expr(f"INTERVAL {step}"))


def parse(s: Column, fmt: str) -> Column:
    """Null where it doesn't parse, as for a value that is no date."""
    return F.try_to_timestamp(s, F.lit(fmt))


def in_zone(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def _since_1970(unit: str, ts: Column) -> Column:
    return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def to_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.floor(_since_1970("MICROSECOND", ts) / 1_000_000)


def to_nanos(ts: Column) -> Column:
    """Nanoseconds since 1970 of a time without a zone as bigint; times hold microseconds."""
    return _since_1970("MICROSECOND", ts) * 1000


def parse_duration(s: Column) -> Column:
    """Microseconds of a duration [-]hours:minutes:seconds[.fraction]; null where it doesn't parse."""
    p = r"^\s*(-?)(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6})\d*)?\s*$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, p, i), F.lit("")).cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(s, p, 5), 6, "0").try_cast("long")
    total = ((part(2) * 60 + part(3)) * 60 + part(4)) * 1_000_000 + F.coalesce(fraction, F.lit(0))
    return F.when(s.rlike(p), F.when(F.regexp_extract(s, p, 1) == "-", -total).otherwise(total))


def parse_iso(s: Column) -> Column:
    """A time without a zone from yyyymmddThhmmss or yyyy-mm-dd[ T]hh:mm:ss[.f]; null for others."""
    plain = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3 $4:$5:$6")
    return plain.try_cast("timestamp_ntz")


#: The ends of time, which stand for the infinities; a value that is no time is null.
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


def parse_special(s: Column) -> Column:
    """parse_iso with the names of special values: not-a-date-time, +infinity and -infinity."""
    name = F.lower(F.trim(s))
    end = lambda v: F.lit(v).cast("timestamp_ntz")
    return F.when(name == "not-a-date-time", F.lit(None)).when(name.isin("+infinity", "infinity"), end(LAST)).when(name == "-infinity", end(FIRST)).otherwise(parse_iso(s))


def is_special(ts: Column) -> Column:
    return ts.isNull() | ts.isin(*[F.lit(v).cast("timestamp_ntz") for v in (FIRST, LAST)])
