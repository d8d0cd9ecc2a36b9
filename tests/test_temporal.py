import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import at
from leadgrid.functions import temporal as t


def one(spark, expr, value, kind="timestamp_ntz"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def half_hour(c):
    return t.from_half_hour_slot(t.half_hour_slot(c))


TRUNCATIONS = [
    (t.trunc_day, "2024-03-10 02:45:10", "2024-03-10 00:00:00"),
    (t.trunc_hour, "2024-03-10 02:45:10.5", "2024-03-10 02:00:00"),
    (half_hour, "2024-03-10 02:45:10", "2024-03-10 02:30:00"),
    (half_hour, "2024-03-10 02:29:59.999999", "2024-03-10 02:00:00"),
    (half_hour, "1969-12-31 23:30:00", "1969-12-31 23:30:00"),
]


@pytest.mark.parametrize("fn, given, want", TRUNCATIONS)
def test_truncation_in_a_zone_that_skips_the_hour(new_york, fn, given, want):
    # 02:00-03:00 on this day does not exist in the session zone
    assert one(new_york, fn, at(given)) == at(want)


ISO = [
    ("2024-07-01T01:30:00Z", "2024-07-01 01:30:00"),
    ("2024-07-01T01:30:00.250Z", "2024-07-01 01:30:00.250"),
    ("2024-07-01T01:30:00+01:00", "2024-07-01 00:30:00"),
    ("2024-07-01T01:30:00", "2024-07-01 01:30:00"),
    ("2024-03-10T02:30:00Z", "2024-03-10 02:30:00"),
]


@pytest.mark.parametrize("text, want", ISO)
def test_parse_iso_is_utc_whatever_the_session_zone(new_york, text, want):
    assert one(new_york, t.parse_iso, text, "string") == at(want)


def test_iso_round_trip(new_york):
    moment = at("2024-03-10 02:30:00.125")
    assert one(new_york, lambda c: t.parse_iso(t.format_iso(c)), moment) == moment


def test_malformed_iso_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, t.parse_iso, "not a time", "string")


LOCAL = [
    ("2024-03-31 00:30:00", "2024-03-31 00:30:00"),
    ("2024-03-31 01:00:00", "2024-03-31 02:00:00"),  # 01:00 local is skipped
    ("2024-10-27 00:30:00", "2024-10-27 01:30:00"),
    ("2024-10-27 01:30:00", "2024-10-27 01:30:00"),  # and repeats
    ("2024-07-01 23:30:00", "2024-07-02 00:30:00"),
]


@pytest.mark.parametrize("utc, local", LOCAL)
def test_local_time(new_york, utc, local):
    assert one(new_york, lambda c: t.to_local(c, "Europe/London"), at(utc)) == at(local)


def test_weekday_is_monday_first(spark):
    days = [one(spark, t.iso_weekday, at("2024-01-01") + dt.timedelta(days=i)) for i in range(7)]
    assert days == [1, 2, 3, 4, 5, 6, 7]


def test_shift_moves_real_hours(new_york):
    back = one(new_york, lambda c: t.shift(c, days=-7, hours=-2), at("2024-03-13 02:30:00"))
    assert back == at("2024-03-06 00:30:00")


def test_epoch_hour(new_york):
    assert one(new_york, t.epoch_hour, at("1970-01-02 03:59:00")) == 27


def test_from_epoch_seconds(new_york):
    assert one(new_york, t.from_epoch_seconds, 1_704_067_200, "bigint") == at("2024-01-01")
