"""The whole build: landed files to staged views to checked tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.operators import checks, scoring, staging
from leadgrid.operators.lookups import BLOCK, DayBlocks
from leadgrid.plans import walk_forward as wf
from leadgrid.plans.mart import by_block, lead_span, past_demand, read_past
from leadgrid.sources import bronze
from leadgrid.sources.storage import as_table, as_view, load, stored


@dataclass(frozen=True)
class BronzePaths:
    demand: str
    forecast: str
    holidays: str


def build_silver(
    spark: SparkSession, paths: BronzePaths, cfg: PitConfig, layer: str | None = None
) -> DataFrame:
    """Staging views over Bronze, and the hourly table; returns the (check,
    n_violations) seen on demand.

    Tripwires and row checks are counted while the hourly table is written from
    what was landed, so Bronze is read once; any violation raises before the
    table is published. The hourly table is stored because every later read of
    past demand goes to it. ``layer`` names another Silver, so that builds can
    share a session.
    """
    demand = bronze.read_demand(spark, paths.demand, cfg)
    holidays = bronze.read_holidays(spark, paths.holidays)
    checks.enforce(checks.holiday_payload_checks(holidays))
    as_view(staging.stage_demand(demand, cfg), "demand", layer)
    forecast = bronze.read_forecast(spark, paths.forecast, cfg)
    as_view(staging.stage_forecast(forecast, cfg), "weather_forecast", layer)
    as_view(staging.stage_holidays(holidays), "bank_holidays", layer)

    landed = checks.Watch(demand, {}, checks.payload_counts(checks.DEMAND_REQUIRED, "demand"))
    rows = checks.Watch(staging.stage_demand(landed.df, cfg), checks.demand_rules())
    copied = (F.col("_n") > 1) & F.col("start_time").isNotNull()
    halves = checks.Watch(staging.half_hours(rows.df, cfg), {"demand.start_time unique": copied})
    judge = lambda: checks.enforce_watched(landed, rows, halves)
    as_table(staging.hours_of(halves.df, cfg), "demand_hourly", layer, judge=judge)
    return rows.results(spark).unionByName(halves.results(spark))


class Laid(NamedTuple):
    forecast: DataFrame
    past: DayBlocks
    seen: checks.Watch


def lay_out(spark: SparkSession, cfg: PitConfig, silver: str | None = None) -> Laid:
    """Demand and forecast as Silver tables in buckets of (series, block), so
    that they meet without a shuffle, now and in later reads.

    A block holds weeks of one series, so none is hot. The forecast is written
    first, checked on the way, in the blocks that the configured leads need; if
    it holds leads that reach further, demand needs longer blocks and the join
    shuffles it once.
    """
    keys = [*cfg.series, BLOCK]
    hourly = load(spark, "demand_hourly", silver)
    usual = past_demand(hourly, cfg, (0, cfg.max_lead))
    marked = checks.mark_copies(load(spark, "weather_forecast", silver), [*cfg.series, "target_ts", "issue_ts"])
    seen = checks.Watch(marked, checks.forecast_rules() | {"weather_forecast grain unique": F.col(checks.COPY)})
    rows = by_block(seen.df.drop(checks.COPY), usual.days)
    forecast = as_table(rows, "forecast_blocks", silver, bucket_by=keys, judge=lambda: checks.enforce_watched(seen))
    past = past_demand(hourly, cfg, lead_span(forecast) or (0, cfg.max_lead))
    stored_blocks = as_table(past.table, "demand_blocks", silver, bucket_by=keys)
    if past.days != usual.days:
        forecast = by_block(forecast.drop("_hour", BLOCK), past.days)
    return Laid(forecast, replace(past, table=stored_blocks), seen)


def checked_gold(
    spark: SparkSession, cfg: PitConfig, partition_by_month: bool = False, silver: str | None = None,
    gold: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mart table, from demand and forecast laid out for their join, and the
    (check, n_violations) seen on forecast and mart.

    The mart is evaluated once: its checks are counted while it is written, and
    it is published if they hold.
    """
    forecast, past, on_forecast = lay_out(spark, cfg, silver)
    # rows of a key lie in one block, so marking copies needs no shuffle
    met = checks.mark_copies(forecast.join(past.table, past.keys), [*past.keys, "target_ts", "lead_days"])
    mart = read_past(met, past, load(spark, "bank_holidays", silver), cfg, (checks.COPY,))
    seen = checks.Watch(mart, checks.mart_rules(cfg) | {"demand_features grain unique": F.col(checks.COPY)})
    rows, months = seen.df.drop(checks.COPY), ["target_month"] if partition_by_month else []
    if months:
        rows = rows.select("*", F.trunc("target_ts", "month").alias("target_month"))
    judge = lambda: checks.enforce_watched(seen)
    table = as_table(rows, "demand_features", gold, partition_by=months, judge=judge)
    return table, on_forecast.results(spark).unionByName(seen.results(spark))


def build_gold(spark: SparkSession, cfg: PitConfig, **how) -> DataFrame:
    """The mart table; see ``checked_gold``."""
    return checked_gold(spark, cfg, **how)[0]


def run_checks(
    spark: SparkSession, cfg: PitConfig, silver: str | None = None, gold: str | None = None
) -> DataFrame:
    """(check, n_violations) over all layers."""
    return (
        checks.demand_checks(load(spark, "demand", silver), cfg)
        .unionByName(checks.hourly_checks(load(spark, "demand_hourly", silver), cfg))
        .unionByName(checks.forecast_checks(load(spark, "weather_forecast", silver), cfg))
        .unionByName(checks.holiday_checks(load(spark, "bank_holidays", silver)))
        .unionByName(checks.mart_checks(load(spark, "demand_features", gold), cfg))
    )


def baseline_report(spark: SparkSession, start, cfg: PitConfig) -> DataFrame:
    """Scores of the baseline on the holdout, per lead."""
    rows = scoring.holdout(load(spark, "demand_features"), start, cfg)
    return scoring.score_by_lead(scoring.with_legal_anchor(scoring.with_baseline(rows, cfg)))


def model_report(
    spark: SparkSession, folds: list, cfg: PitConfig, params=wf.PARAMS, **how
) -> dict[str, DataFrame]:
    """Walk-forward results: improvement on the baseline and errors by slice,
    whose counts must add up to all rows."""
    frame = wf.training_frame(load(spark, "demand_features"), cfg)
    rows = scoring.with_legal_anchor(wf.walk_forward(frame, folds, cfg, params=params, **how))
    measured = stored(scoring.slice_measures(scoring.with_slices(rows)), "slices")
    totals = scoring.slice_totals(measured)
    short = totals.where(F.col("n_sliced") != F.col("n_rows")).collect()
    if short:
        raise ValueError(f"slices that do not cover all rows: {short}")
    return {"improvement": scoring.improvement(rows), "slices": measured.where(F.col("value").isNotNull())}
