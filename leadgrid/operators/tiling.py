"""Backfill windows and walk-forward folds, as rows derived from a span.

A span is a row with ``start_date`` and ``end_date``, both inclusive.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _days(n: int):
    return F.make_dt_interval(F.lit(n))


def span_of(df: DataFrame, date_col: str, *keys: str) -> DataFrame:
    """First and last date, per key if any are given."""
    day = F.col(date_col).cast("date")
    return df.groupBy(*keys).agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"))


def _windows(spans: DataFrame, last_start, step: int, width: int) -> DataFrame:
    keys = [c for c in spans.columns if c not in ("start_date", "end_date")]
    starts = F.when(
        F.col("start_date") <= last_start, F.sequence(F.col("start_date"), last_start, _days(step))
    )
    lo = F.col("window_start")
    return (
        spans.select(*keys, "end_date", F.explode(starts).alias("window_start"))
        .withColumn("window_end", F.least(F.date_add(lo, width - 1), F.col("end_date")))
        .drop("end_date")
    )


def date_windows(spans: DataFrame, days: int) -> DataFrame:
    """Consecutive inclusive windows of at most ``days`` days."""
    if days < 1:
        raise ValueError("a window needs at least one day")
    return _windows(spans, F.col("end_date"), days, days)


def overlapping_windows(spans: DataFrame, days: int, max_lead: int) -> DataFrame:
    """Windows whose writable parts ``[start, end - max_lead]`` tile the span.

    Neighbours overlap by ``max_lead`` days, so only the last ``max_lead``
    issue dates of the span are in no writable part.
    """
    if days <= max_lead:
        raise ValueError(f"a window of {days} days has no day that is whole at lead {max_lead}")
    windows = _windows(spans, F.date_sub("end_date", max_lead), days - max_lead, days)
    return windows.withColumn("writable_end", F.date_sub("window_end", max_lead))


class Fold(NamedTuple):
    """Training uses days before ``train_end``; the test side is the days from
    ``test_start`` up to, but not on, ``test_end``. Field names are fixed values."""

    train_end: dt.date
    test_start: dt.date
    test_end: dt.date


def folds(spans: DataFrame, max_lead: int) -> DataFrame:
    """One fold per whole month of the span: train on all before the month,
    less a purge of ``max_lead`` days, then test on the month.

    Months are stepped one from the other, so windows tile whatever day of the
    month the span starts on.
    """
    start, end = F.col("start_date"), F.col("end_date")
    months = F.floor(F.months_between(end, start)).cast("int") + 1
    bounds = F.aggregate(
        F.sequence(F.lit(1), F.greatest(months, F.lit(1))),
        F.array(start),
        lambda dates, _: F.concat(dates, F.array(F.add_months(F.element_at(dates, -1), 1))),
    )
    steps = F.transform(
        bounds,
        lambda d: F.struct(d.alias("test_start"), F.add_months(d, 1).alias("test_end")),
    )
    return (
        spans.select("end_date", F.inline(steps))
        .where(F.col("test_end") <= F.col("end_date"))
        .select(F.date_sub("test_start", max_lead).alias("train_end"), "test_start", "test_end")
    )


def fold_faults(
    fold_rows: DataFrame, membership: DataFrame, max_lead: int, end: dt.date | Column
) -> DataFrame:
    """(train_end, test_start, test_end, fault), a row for each fault of a fold:
    training into the purge, testing past the end, an empty side, or training
    data not before the test data."""
    keys = list(Fold._fields)
    end = end if isinstance(end, Column) else F.lit(end)
    faults = {
        "purge": F.col("train_end") > F.date_sub("test_start", max_lead),
        "end": F.col("test_end") > end,
        "empty train": F.coalesce("n_train", F.lit(0)) == 0,
        "empty test": F.coalesce("n_test", F.lit(0)) == 0,
        "overlap": F.col("last_train") >= F.col("first_test"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in faults.items()]))
    return fold_rows.join(membership, keys, "left").select(*keys, F.explode(found).alias("fault"))


def collect_folds(fold_rows: DataFrame) -> list[Fold]:
    """Folds on the driver: one short row per month of the holdout."""
    return [Fold(*row) for row in fold_rows.orderBy("test_start").collect()]


def fold_membership(rows: DataFrame, fold_list: list[Fold], train_start: dt.date | None = None) -> DataFrame:
    """Size and time bounds of the train and test side of every fold; training
    begins at ``train_start``, if given.

    Rows are first counted per day; a day then goes to the folds whose sides
    contain it, so the expanding training windows never multiply the rows.
    """
    day = F.col("target_ts").cast("date")
    days = rows.groupBy(day.alias("_day")).agg(
        F.count("*").alias("_n"), F.min("target_ts").alias("_lo"), F.max("target_ts").alias("_hi")
    )
    every = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in f._asdict().items()]) for f in fold_list]
    )
    train = F.col("_day") < F.col("train_end")
    if train_start is not None:
        train = train & (F.col("_day") >= F.lit(train_start))
    test = (F.col("_day") >= F.col("test_start")) & (F.col("_day") < F.col("test_end"))
    return (
        days.select("*", F.inline(every))
        .groupBy("train_end", "test_start", "test_end")
        .agg(
            F.coalesce(F.sum(F.when(train, F.col("_n"))), F.lit(0)).alias("n_train"),
            F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0)).alias("n_test"),
            F.max(F.when(train, F.col("_hi"))).alias("last_train"),
            F.min(F.when(test, F.col("_lo"))).alias("first_test"),
        )
    )


def fold_rows(rows: DataFrame, fold_list: list[Fold], train_start: dt.date | None = None) -> DataFrame:
    """Each row once for every fold and side it belongs to: its columns, the
    fold's three dates and ``side``, "train" or "test".

    A range join through months: a fold's sides are listed by the months they
    touch, rows meet their month's list by equality, and the bounds are checked
    where a month is cut. Listed folds are bounded by folds times months, so they
    are broadcast and rows stay where they are.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame(fold_list, "train_end date, test_start date, test_end date")
    month = F.trunc(F.col("target_ts").cast("date"), "month")
    begin = F.lit(train_start) if train_start is not None else F.lit(None).cast("date")
    first = rows.agg(F.min("target_ts").cast("date")).first()[0]  # where open training begins
    sides = F.array(
        F.struct(F.lit("train").alias("side"), F.coalesce(begin, F.lit(first)).alias("_lo"), F.col("train_end").alias("_hi")),
        F.struct(F.lit("test").alias("side"), F.col("test_start").alias("_lo"), F.col("test_end").alias("_hi")),
    )
    months = F.sequence(F.trunc("_lo", "month"), F.date_sub("_hi", 1), F.expr("INTERVAL 1 MONTH"))
    buckets = (
        listed.select("*", F.inline(sides))
        .where(F.col("_lo") < F.col("_hi"))
        .withColumn("_month", F.explode(months))
    )
    day = F.col("target_ts").cast("date")
    met = rows.withColumn("_month", month).join(F.broadcast(buckets), "_month")
    return met.where((day >= F.col("_lo")) & (day < F.col("_hi"))).drop("_month", "_lo", "_hi")


def membership_violations(membership: DataFrame) -> DataFrame:
    """Folds with an empty side, or training data not before the test data."""
    return membership.where(
        (F.col("n_train") == 0) | (F.col("n_test") == 0) | (F.col("last_train") >= F.col("first_test"))
    )
