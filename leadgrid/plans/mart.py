"""The feature mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.temporal import epoch_hour, trunc_hour
from leadgrid.operators.features import (
    add_cutoff,
    add_degree_hinges,
    attach_anchors,
    attach_calendar,
    attach_cutoff_lag,
    attach_label,
    broadcast_small,
    keep_trainable,
    mart_columns,
)
from leadgrid.operators.lookups import BLOCK, DAY, DayBlocks, block_of, day_blocks

#: hours of a shared forecast that are broadcast, some 20 years
SHARED_HOURS = 24 * 366 * 20


def lead_span(forecast: DataFrame) -> tuple[int, int] | None:
    """Least and greatest lead: of a stored forecast, from its files' statistics."""
    least, most = forecast.agg(F.min("lead_days"), F.max("lead_days")).first()
    return None if least is None else (least, most)


def past_demand(hourly: DataFrame, cfg: PitConfig, leads: tuple[int, int]) -> DayBlocks:
    """Hourly demand by (series, block), as far back and ahead as these leads read."""
    distances = [*cfg.anchor_columns.values(), *map(cfg.lag_hours, leads)]
    back, ahead = max(0, *distances), max(0, *(-d for d in distances))
    return day_blocks(hourly, cfg.series, "avg_initial_demand_outturn", back, ahead)


def by_block(forecast: DataFrame, days: int) -> DataFrame:
    """Forecast rows with their target's hour and block of ``days`` days.

    No series has values at other times than full hours."""
    on_the_hour = forecast.where(trunc_hour(F.col("target_ts")) == F.col("target_ts"))
    hour = epoch_hour(F.col("target_ts"))
    return on_the_hour.withColumns({"_hour": hour, BLOCK: block_of(F.floor(hour / DAY), days)})


def _shared_met(forecast: DataFrame, past: DayBlocks) -> DataFrame:
    """Rows of a forecast that lacks a series column, for every series.

    Its hours would be hot keys. They are gathered by hour, a few leads each,
    and that table of hours is broadcast if it is not too long; the hours of
    every series come from its own values.
    """
    shared = [c for c in past.series if c in forecast.columns]
    rows = by_block(forecast, past.days).drop(BLOCK)
    runs = F.collect_list(F.struct(*[c for c in rows.columns if c not in (*shared, "_hour")])).alias("_runs")
    hours = broadcast_small(rows.groupBy(*shared, "_hour").agg(runs), SHARED_HOURS)
    met = past.hours().join(hours, [*shared, "_hour"])
    return met.select(*past.series, "_days", "_values", "_hour", F.inline("_runs"))


def read_past(
    met: DataFrame, past: DayBlocks, holidays: DataFrame, cfg: PitConfig, extra: tuple[str, ...] = ()
) -> DataFrame:
    """The mart, from forecast rows next to the values around their hour, with
    the forecast's columns ``extra``.

    An anchor ``h`` hours back was published by the cutoff exactly when ``h``
    is at least the lead's own distance.
    """
    hour, distance = F.col("_hour"), F.col("lead_days") * 24 + cfg.publication_lag_hours
    values = {
        "demand_mw": past.value(hour),
        "demand_lag_mw": past.value(hour - distance),
        **{name: F.when(distance <= h, past.value(hour - h)) for name, h in cfg.anchor_columns.items()},
    }
    kept = [c for c in met.columns if c not in ("_days", "_values", "_hour", BLOCK)]
    rows = add_cutoff(keep_trainable(met.select(*kept, *[v.alias(n) for n, v in values.items()])), cfg)
    rows = rows.withColumn("demand_lag_ts", trunc_hour(F.col("cutoff")))
    return add_degree_hinges(attach_calendar(rows, holidays, cfg), cfg).select(*mart_columns(cfg), *extra)


def build_mart(
    forecast: DataFrame,
    hourly: DataFrame,
    holidays: DataFrame,
    cfg: PitConfig,
    leads: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per (target, lead) that has a label and a lagged demand.

    Demand is gathered by (series, block of days), and forecast rows, the
    longest input, are shuffled once to the block of their target. There label,
    anchors and the lagged demand of any lead, negative ones too, are read by
    their distance. An inner join is enough: a target without demand has no
    label. A forecast without series columns serves every series.

    How far a block reaches follows from the least and greatest lead. They are
    looked up if not given, so pass a stored forecast or ``leads``.
    """
    past = past_demand(hourly, cfg, leads or lead_span(forecast) or (0, cfg.max_lead))
    if set(cfg.series) <= set(forecast.columns):
        met = by_block(forecast, past.days).join(past.table, past.keys)
    else:
        met = _shared_met(forecast, past)
    return read_past(met, past, holidays, cfg)


def joined_features(
    forecast: DataFrame, hourly: DataFrame, holidays: DataFrame, cfg: PitConfig
) -> DataFrame:
    """The mart's columns for every forecast row, one left join per value."""
    absent = [c for c in cfg.series if c not in forecast.columns]
    if absent:
        every = hourly.select(*cfg.series, F.col("target_hour").alias("target_ts"))
        forecast = forecast.join(every, [c for c in every.columns if c not in absent])
    rows = attach_label(forecast, hourly, cfg)
    rows = attach_cutoff_lag(add_cutoff(rows, cfg), hourly, cfg)
    rows = attach_calendar(attach_anchors(rows, hourly, cfg), holidays, cfg)
    return add_degree_hinges(rows, cfg).select(*mart_columns(cfg))


def build_mart_by_joins(
    forecast: DataFrame, hourly: DataFrame, holidays: DataFrame, cfg: PitConfig
) -> DataFrame:
    """The same mart as a chain of left joins.

    Takes any lead; every join reshuffles the forecast rows unless the hourly
    table is small enough to broadcast.
    """
    return keep_trainable(joined_features(forecast, hourly, holidays, cfg))


def serving_rows(
    forecast: DataFrame, hourly: DataFrame, holidays: DataFrame, cfg: PitConfig
) -> DataFrame:
    """Feature rows to predict: targets need no label yet, only a known lag."""
    return joined_features(forecast, hourly, holidays, cfg).dropna(subset=["demand_lag_mw"])
