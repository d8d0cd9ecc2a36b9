import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadgrid.operators import tiling

D = dt.date


def span(spark, lo, hi):
    return spark.createDataFrame([(lo, hi)], "start_date date, end_date date")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("days, width", [(28, 28), (10, 3), (1, 5), (5, 1), (30, 30)])
def test_windows_tile(spark, days, width):
    lo = D(2024, 7, 1)
    hi = lo + dt.timedelta(days=days - 1)
    got = rows(tiling.date_windows(span(spark, lo, hi), width))
    covered = [w[0] + dt.timedelta(days=i) for w in got for i in range((w[1] - w[0]).days + 1)]
    assert covered == [lo + dt.timedelta(days=i) for i in range(days)]
    assert all((w[1] - w[0]).days < width for w in got)


def stepped(lo, hi, n, lead):
    """The window rule stepped one window at a time."""
    out, cur = [], lo
    while cur + dt.timedelta(days=lead) <= hi:
        end = min(cur + dt.timedelta(days=n - 1), hi)
        out.append((cur, end, end - dt.timedelta(days=lead)))
        cur = end + dt.timedelta(days=1 - lead)
    return out


@pytest.mark.parametrize("days", [5, 8, 9, 29, 30, 31, 52, 53, 54, 741])
def test_overlapping_windows_equal_the_stepped_rule(spark, days):
    lo = D(2024, 7, 1)
    hi = lo + dt.timedelta(days=days - 1)
    assert rows(tiling.overlapping_windows(span(spark, lo, hi), 30, 7)) == stepped(lo, hi, 30, 7)


def test_writable_parts_tile(spark):
    """Two years in 30-day windows: 32 windows, 734 consecutive issue dates."""
    got = rows(tiling.overlapping_windows(span(spark, D(2024, 7, 1), D(2026, 7, 11)), 30, 7))
    days = [w[0] + dt.timedelta(days=i) for w in got for i in range((w[2] - w[0]).days + 1)]
    assert len(got) == 32
    assert days == [D(2024, 7, 1) + dt.timedelta(days=i) for i in range(734)]


@pytest.mark.parametrize("width", [1, 7])
def test_window_that_cannot_progress_is_refused(spark, width):
    with pytest.raises(ValueError):
        tiling.overlapping_windows(span(spark, D(2024, 7, 1), D(2024, 8, 1)), width, 7)


def test_default_folds(spark):
    end = D(2026, 7, 11)
    table = tiling.folds(span(spark, D(2025, 7, 1), end), 7)
    got = tiling.collect_folds(table)
    assert len(got) == 12
    assert got[0] == (D(2025, 6, 24), D(2025, 7, 1), D(2025, 8, 1))
    assert all(a.test_end == b.test_start for a, b in zip(got, got[1:]))
    assert got[-1].test_end == D(2026, 7, 1)
    members = table.select(
        "*", F.lit(1).alias("n_train"), F.lit(1).alias("n_test"),
        F.col("train_end").alias("last_train"), F.col("test_start").alias("first_test"),
    )
    assert tiling.fold_faults(table, members, 7, end).count() == 0
    assert {r["fault"] for r in tiling.fold_faults(table, members, 8, end).collect()} == {"purge"}
    assert tiling.fold_faults(table, members, 8, end).count() == 12
    none = tiling.fold_faults(table, members.limit(0), 7, end)
    assert {r["fault"] for r in none.collect()} == {"empty train", "empty test"} and none.count() == 24


def test_folds_from_the_end_of_a_month(spark):
    got = tiling.collect_folds(tiling.folds(span(spark, D(2025, 1, 31), D(2025, 4, 30)), 7))
    assert [f.test_start for f in got] == [D(2025, 1, 31), D(2025, 2, 28), D(2025, 3, 28)]
    assert got[-1].test_end == D(2025, 4, 28)


@pytest.mark.parametrize("end, n", [(D(2025, 7, 31), 0), (D(2025, 8, 1), 1), (D(2025, 7, 1), 0)])
def test_a_fold_needs_its_whole_month(spark, end, n):
    assert tiling.folds(span(spark, D(2025, 7, 1), end), 7).count() == n


def test_membership(spark):
    fold = tiling.Fold(D(2025, 6, 24), D(2025, 7, 1), D(2025, 8, 1))
    times = ["2025-06-23 23:00:00", "2025-06-24 00:00:00", "2025-07-01 00:00:00", "2025-07-31 23:00:00", "2025-08-01 00:00:00"]
    frame = spark.createDataFrame([(dt.datetime.fromisoformat(t),) for t in times], "target_ts timestamp_ntz")
    got = tiling.fold_membership(frame, [fold])
    row = got.first()
    assert (row["n_train"], row["n_test"]) == (1, 2)
    assert tiling.membership_violations(got).count() == 0
    empty = tiling.fold_membership(frame.where("target_ts < '2025-07-01'"), [fold])
    assert tiling.membership_violations(empty).count() == 1


@pytest.mark.parametrize("train_start", [None, dt.date(2024, 2, 10)])
def test_fold_rows_are_the_members_of_each_side(spark, train_start):
    pick = random.Random(5)
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=pick.randrange(24 * 200)) for _ in range(400)]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "target_ts timestamp_ntz, id int")
    folds = [
        tiling.Fold(dt.date(2024, 3, 25), dt.date(2024, 4, 1), dt.date(2024, 5, 1)),
        tiling.Fold(dt.date(2024, 4, 8), dt.date(2024, 4, 15), dt.date(2024, 6, 15)),
        tiling.Fold(dt.date(2023, 1, 1), dt.date(2024, 7, 1), dt.date(2024, 7, 2)),
    ]
    want = set()
    for f in folds:
        for i, t in enumerate(times):
            if (train_start is None or t.date() >= train_start) and t.date() < f.train_end:
                want.add((f.test_start, "train", i))
            if f.test_start <= t.date() < f.test_end:
                want.add((f.test_start, "test", i))
    found = tiling.fold_rows(rows, folds, train_start)
    got = [(r["test_start"], r["side"], r["id"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    sizes = {(r["test_start"], s): r[f"n_{s}"] for r in tiling.fold_membership(rows, folds, train_start).collect() for s in ("train", "test")}
    counted = {(r["test_start"], r["side"]): r["count"] for r in found.groupBy("test_start", "side").count().collect()}
    assert {k: n for k, n in sizes.items() if n} == counted
