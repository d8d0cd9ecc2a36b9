"""Time expressions on zone-less UTC timestamps.

Everything stays ``timestamp_ntz``: the built-in ``date_trunc`` turns it into
an instant of the session zone, so truncation here is date + time-of-day
arithmetic, which gives the same answer under any session zone.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


def ntz(value: dt.datetime | dt.date) -> Column:
    """Literal for a naive datetime, or for midnight of a date."""
    return F.lit(str(value)).cast("timestamp_ntz")


def interval(days: Column | int = 0, hours: Column | int = 0, minutes: Column | int = 0) -> Column:
    """Day-time interval as products of unit intervals, which cost a row less
    than ``make_dt_interval`` and its decimal seconds."""
    parts = {"DAY": days, "HOUR": hours, "MINUTE": minutes}
    used = [F.expr(f"INTERVAL '1' {u}") * n for u, n in parts.items() if not (isinstance(n, int) and n == 0)]
    return reduce(Column.__add__, used or [F.expr("INTERVAL '0' DAY")])


def shift(ts: Column, days: Column | int = 0, hours: Column | int = 0) -> Column:
    """``ts`` moved by real days and hours (negative moves back)."""
    return ts + interval(days, hours)


def trunc_day(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def trunc_hour(ts: Column) -> Column:
    return trunc_day(ts) + interval(hours=F.hour(ts))


def epoch_hour(ts: Column) -> Column:
    """Whole hours since 1970, the integer axis for range windows."""
    return F.unix_date(ts.cast("date")).cast("long") * 24 + F.hour(ts)


def from_epoch_hour(hour: Column) -> Column:
    return shift(ntz(EPOCH), hours=hour.cast("int"))


def half_hour_slot(ts: Column) -> Column:
    """Whole half hours since 1970, a compact grouping key."""
    return epoch_hour(ts) * 2 + (F.minute(ts) >= 30).cast("int")


def from_half_hour_slot(slot: Column) -> Column:
    return ntz(EPOCH) + interval(minutes=slot.cast("int") * 30)


def from_epoch_seconds(seconds: Column) -> Column:
    return ntz(EPOCH) + F.expr("INTERVAL '1' SECOND") * seconds


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to UTC; text without an offset is taken as UTC."""
    has_offset = text.endswith("Z") | text.rlike(r"[+-]\d{2}:?\d{2}$")
    micros = F.expr("INTERVAL '0.000001' SECOND") * F.unix_micros(F.to_timestamp(text))
    return F.when(has_offset, ntz(EPOCH) + micros).otherwise(text.cast("timestamp_ntz"))


def format_iso(ts: Column) -> Column:
    return F.concat(F.translate(ts.cast("string"), " ", "T"), F.lit("Z"))


def to_local(ts: Column, tz: str) -> Column:
    """UTC to wall-clock time in ``tz``, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def iso_weekday(ts: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(ts) + 1
