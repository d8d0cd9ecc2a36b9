"""Blocked windows against brute force, with gaps and across blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fixtures import H, at, hourly_frame, hours
from leadgrid.functions.temporal import from_epoch_hour
from leadgrid.operators import lookups


def series_with_gaps(seed, n=4000):
    rng = random.Random(seed)
    return [t for t in hours("2024-01-01", n) if rng.random() > 0.3]


VALUE = "avg_initial_demand_outturn"


def read(frame, series, distances, back=None, ahead=0):
    """Each hour with the values at the distances behind it."""
    past = lookups.day_blocks(frame, series, VALUE, back or max(distances.values()), ahead)
    rows = past.hours()
    return rows.select(
        *series, "_block", from_epoch_hour(F.col("_hour")).alias("target_hour"),
        *[past.value(F.col("_hour") - n).alias(name) for name, n in distances.items()],
    )


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_value_at_exact_distance(spark, seed):
    times = series_with_gaps(seed)
    known = {t: float(i) for i, t in enumerate(times)}
    frame = hourly_frame(spark, times, known.__getitem__)
    distances = {"own": 0, "a": 1, "b": 170, "c": 336, "later": -30}
    got = read(frame, (), distances, ahead=30).collect()
    assert len(got) == len(times)
    for row in got:
        for name, n in distances.items():
            assert row[name] == known.get(row["target_hour"] - n * H)


def test_rolling_range_counts_time_not_rows(spark):
    times = series_with_gaps(3)
    frame = hourly_frame(spark, times)
    got = lookups.over_hours(frame, (), {"n": (F.count("*"), 23, 0)}).collect()
    for row in got:
        now = row["target_hour"]
        assert row["n"] == sum(now - 23 * H <= t <= now for t in times)


def test_series_do_not_see_each_other(spark):
    times = hours("2024-01-01", 48)
    both = hourly_frame(spark, times).withColumn("s", F.explode(F.array(F.lit("x"), F.lit("y"))))
    own = both.withColumn(
        "avg_initial_demand_outturn",
        F.when(F.col("s") == "x", F.col("avg_initial_demand_outturn")).otherwise(-1.0),
    )
    got = read(own, ("s",), {"a": 24})
    assert got.where((F.col("s") == "y") & (F.col("a") != -1.0)).count() == 0
    assert got.where(F.col("a").isNotNull()).count() == 48


def test_one_long_series_is_spread_over_blocks(spark):
    """Each block holds a bounded number of rows, history included."""
    times = hours("2000-01-01", 24 * 365 * 3)
    frame = hourly_frame(spark, times)
    got = read(frame, (), {"a": 336})
    assert got.count() == len(times)
    assert got.where(F.col("a").isNull()).count() == 336
    assert got.groupBy("_block").count().agg(F.max("count")).first()[0] == lookups.MIN_BLOCK_HOURS
    days = lookups.day_blocks(frame, (), VALUE, 336).table.agg(F.max(F.size("_days"))).first()[0]
    assert days == lookups.MIN_BLOCK_HOURS // 24 + 14


def test_a_long_reach_holds_only_days_that_are_there(spark):
    """One record with an absurd lead widens the blocks, not what they hold."""
    times = [at("2024-01-01"), at("2024-06-01 05:00:00")]
    past = lookups.day_blocks(hourly_frame(spark, times), (), VALUE, 24 * 100_000)
    assert past.table.agg(F.max(F.size("_days"))).first()[0] == 2


def test_before_1970(spark):
    times = hours("1969-12-01", 24 * 60)
    got = read(hourly_frame(spark, times, lambda t: 1.0), (), {"a": 24})
    assert got.where(F.col("a").isNull()).count() == 24
    assert at("1969-12-01") + dt.timedelta(days=60) == times[-1] + H
