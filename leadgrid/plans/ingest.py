"""One plan per feed: what was fetched is checked, then landed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.operators import checks, reshape, tiling
from leadgrid.sources import bronze
from leadgrid.sources.storage import stored


def ingest_demand(demand: DataFrame, path: str, cfg: PitConfig) -> None:
    """Whole settlement dates; nothing is landed if a required key is missing."""
    envelopes = bronze.demand_envelopes(demand, cfg)
    checks.enforce(checks.payload_checks(envelopes, checks.DEMAND_REQUIRED, "demand"))
    bronze.land(envelopes, path, bronze.DEMAND_KEY)


def ingest_forecast(
    wide: DataFrame, path: str, lo: dt.date, hi: dt.date, cfg: PitConfig, variable: str, per_lead: int = 24
) -> DataFrame:
    """A fetch of the targets ``[lo, hi]``: melted, checked, and landed where an
    issue date of a series is whole. Returns what was withheld."""
    names = reshape.variable_names(variable, cfg.max_lead)
    long = reshape.melt_previous_runs(wide, cfg, names)
    checks.enforce(checks.long_frame_checks(long))
    return bronze.land_complete_forecast(long, path, lo, hi, cfg, per_lead)


def in_windows(long: DataFrame, windows: DataFrame) -> DataFrame:
    """The records of each window's fetch, with ``window_start`` and whether
    that window may land them.

    ``windows`` are few dates; they are listed in the plan, and a record goes to
    those, mostly one, whose targets include its own.
    """
    listed = [(w["window_start"], w["window_end"], w["writable_end"]) for w in windows.collect()]
    names = ("window_start", "_last", "_writable_end")
    every = F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip(names, w, strict=True)]) for w in listed])
    target, issue = (F.col(c).cast("date") for c in ("target_ts", "issue_ts"))
    holding = F.filter(every, lambda w: target.between(w["window_start"], w["_last"]))
    may_land = issue.between(F.col("window_start"), F.col("_writable_end"))
    return long.select("*", F.inline(holding)).withColumn("_writable", may_land).drop("_last", "_writable_end")


def ingest_windows(
    wide: DataFrame, path: str, span: DataFrame, days: int, cfg: PitConfig, variable: str, per_lead: int = 24
) -> DataFrame:
    """A backfill in overlapping windows, so that every issue date but the
    span's last few is whole in one of them. Returns (window_start, series,
    issue_ts, n) of what was withheld.

    What was fetched is evaluated once: records go to the windows that hold
    them and are judged there in one shuffle, and what is whole is landed in one
    write. An issue date lies in the writable part of one window only. Records
    with faults, or windows without records, raise before anything is landed.
    """
    names = reshape.variable_names(variable, cfg.max_lead)
    windows = tiling.overlapping_windows(span, days, cfg.max_lead)
    seen = checks.Watch(reshape.melt_previous_runs(wide, cfg, names), {}, checks.long_frame_counts())
    held = in_windows(seen.df, windows)
    judged = stored(bronze.by_issue(held, cfg, per_lead, also=("window_start",)), "judged")
    checks.enforce_watched(seen)
    empty = windows.join(judged.select("window_start").distinct(), "window_start", "left_anti").collect()
    if empty:
        raise ValueError(f"windows without records: {[w['window_start'].isoformat() for w in empty]}")
    writable = judged.where("_writable")
    whole = writable.where("_whole").drop("_n", "_whole", "_writable", "window_start")
    bronze.merge_forecast(whole, path, cfg, is_stored=True)
    return bronze.withheld_issues(writable, cfg, also=("window_start",))


def ingest_live(
    wide: DataFrame, path: str, run_date: dt.date, cfg: PitConfig, variables: list[str]
) -> None:
    """One live run, merged into the partition space that backfills fill."""
    long = reshape.melt_live_run(wide, cfg, variables, run_date)
    checks.enforce(checks.long_frame_checks(long))
    bronze.merge_forecast(long, path, cfg)


def ingest_holidays(feed: DataFrame, path: str) -> None:
    checks.enforce(checks.holiday_payload_checks(feed))
    bronze.land_reference(feed, path)
