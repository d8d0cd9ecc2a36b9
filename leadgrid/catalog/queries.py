"""One query per operator, over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadgrid import schemas
from leadgrid.catalog import standins
from leadgrid.catalog.standins import DAILY, HOURLY, NATIONAL, VARIABLE, table
from leadgrid.config import PitConfig
from leadgrid.functions.temporal import iso_weekday, shift, to_local, trunc_hour
from leadgrid.operators import checks, features, reshape, scoring, staging, tiling
from leadgrid.plans import ingest, medallion, tracking, walk_forward
from leadgrid.plans.mart import build_mart, build_mart_by_joins, serving_rows
from leadgrid.sources import bronze
from leadgrid.sources.storage import as_table, as_view, load, scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fewer trees for the registered runs; all else, and the full count, is in walk_forward.
QUICK = walk_forward.TreeParams(trees=10, step=0.3)
QUICK_BAGGED = replace(QUICK, trees=1, row_share=0.8, feature_share="0.8")
HOLDOUT_MONTHS = 12


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


class Inputs:
    """Silver inputs of a mart, each built when first used. Demand is stored,
    so the raw table is read once however many of the inputs a query uses."""

    def __init__(self, demand: DataFrame, cfg: PitConfig, step_hours: int = 1):
        self._demand = demand
        self.cfg = cfg
        self.step_hours = step_hours

    @cached_property
    def demand(self) -> DataFrame:
        return stored(self._demand, "demand")

    @cached_property
    def hourly(self) -> DataFrame:
        return staging.hourly_demand(self.demand, self.cfg)

    @cached_property
    def wide(self) -> DataFrame:
        return standins.weather_wide(self.demand, self.cfg, self.step_hours)

    @cached_property
    def long(self) -> DataFrame:
        names = reshape.variable_names(VARIABLE, self.cfg.max_lead)
        return reshape.melt_previous_runs(self.wide, self.cfg, names)

    @cached_property
    def forecast(self) -> DataFrame:
        return staging.pivot_forecast(self.long, self.cfg)

    @cached_property
    def holidays(self) -> DataFrame:
        return staging.stage_holidays(standins.holiday_feed(self.demand))

    @cached_property
    def shared(self) -> DataFrame:
        """One forecast for all series, without their column."""
        weather = standins.weather_wide(self.demand, NATIONAL, self.step_hours)
        names = reshape.variable_names(VARIABLE, NATIONAL.max_lead)
        return staging.pivot_forecast(reshape.melt_previous_runs(weather, NATIONAL, names), NATIONAL)

    def mart(self) -> DataFrame:
        """The forecast is stored, as the mart reads it for either kind of lead."""
        return build_mart(stored(self.forecast, "forecast"), self.hourly, self.holidays, self.cfg)

    def shared_mart(self) -> DataFrame:
        return build_mart(stored(self.shared, "forecast"), self.hourly, self.holidays, self.cfg)


def by_event(spark, sf_dir) -> Inputs:
    return Inputs(standins.event_demand(spark, sf_dir), HOURLY)


def by_user(spark, sf_dir) -> Inputs:
    return Inputs(standins.event_demand(spark, sf_dir, "user_id"), HOURLY)


def by_priority(spark, sf_dir) -> Inputs:
    return Inputs(standins.order_demand(spark, sf_dir), DAILY, 24)


def order_span(spark, sf_dir) -> tuple[dt.date, dt.date]:
    """First and last order date: one row on the driver."""
    return tuple(tiling.span_of(table(spark, sf_dir, "orders"), "o_orderdate").first())


def holdout_start(last: dt.date, months: int = HOLDOUT_MONTHS) -> dt.date:
    """First day of the month ``months`` before the last date's month."""
    index = last.year * 12 + last.month - 1 - months
    return dt.date(index // 12, index % 12 + 1, 1)


def holdout_span(spark, sf_dir, months: int = HOLDOUT_MONTHS) -> DataFrame:
    orders = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("date").alias("end_date"))
    start = F.add_months(F.trunc("end_date", "month"), -months)
    return orders.select(start.alias("start_date"), "end_date")


def rounded_errors(scores: DataFrame) -> DataFrame:
    """Root mean squares rounded; the other measures are exact."""
    errors = [c for c, t in scores.dtypes if t == "double" and not c.startswith(("mean", "signed"))]
    return scores.withColumns({c: F.round(c, 4) for c in errors})


# Silver and reshaping ------------------------------------------------------


@query
def demand_halfhourly(spark, sf_dir):
    return standins.event_demand(spark, sf_dir)


@query
def demand_hourly(spark, sf_dir):
    return staging.hourly_demand(standins.event_demand(spark, sf_dir), HOURLY)


@query
def demand_hourly_by_user(spark, sf_dir):
    return staging.hourly_demand(standins.event_demand(spark, sf_dir, "user_id"), HOURLY)


@query
def forecast_wide(spark, sf_dir):
    return by_event(spark, sf_dir).wide


@query
def forecast_unpivot(spark, sf_dir):
    return by_event(spark, sf_dir).long


@query
def forecast_unpivot_variables(spark, sf_dir):
    inputs = by_event(spark, sf_dir)
    names = [VARIABLE, "dew_point_2m"]
    wide = inputs.wide.withColumn("dew_point_2m", F.col(f"{VARIABLE}_previous_day1"))
    first = inputs.demand.agg(F.min("settlement_date")).first()[0]
    return reshape.melt_live_run(wide.select("series_id", "date", *names), inputs.cfg, names, first)


@query
def forecast_pivot(spark, sf_dir):
    return by_event(spark, sf_dir).forecast


@query
def forecast_pivot_live(spark, sf_dir):
    live = forecast_unpivot_variables(spark, sf_dir)
    return staging.pivot_forecast(live, HOURLY, (VARIABLE, "dew_point_2m"))


@query
def holidays_union(spark, sf_dir):
    demand = standins.order_demand(spark, sf_dir)
    return staging.stage_holidays(standins.holiday_feed(demand))


# Bronze and layers ---------------------------------------------------------


def _landed_demand(spark, sf_dir) -> str:
    path = scratch_path(spark, "bronze-demand")
    ingest.ingest_demand(standins.event_demand(spark, sf_dir), path, HOURLY)
    return path


@query
def bronze_roundtrip_demand(spark, sf_dir):
    path = _landed_demand(spark, sf_dir)
    return staging.stage_demand(bronze.read_demand(spark, path, HOURLY), HOURLY)


@query
def bronze_range_read(spark, sf_dir):
    """The last seven settlement dates, pruned by directory."""
    path = _landed_demand(spark, sf_dir)
    last = table(spark, sf_dir, "events").agg(F.max("ts").cast("date")).first()[0]
    landed = bronze.read_demand(spark, path, HOURLY, last - dt.timedelta(days=6), last)
    return staging.stage_demand(landed, HOURLY)


@query
def bronze_roundtrip_forecast(spark, sf_dir):
    path = scratch_path(spark, "bronze-forecast")
    long = by_event(spark, sf_dir).long
    bronze.land(bronze.forecast_envelopes(long), path, bronze.FORECAST_KEY)
    return staging.stage_forecast(bronze.read_forecast(spark, path, HOURLY), HOURLY)


@query
def bronze_roundtrip_live(spark, sf_dir):
    """A live run without leads, landed and staged; leads come from the dates."""
    path = scratch_path(spark, "bronze-live")
    bronze.land(
        bronze.forecast_envelopes(forecast_unpivot_variables(spark, sf_dir)), path, bronze.FORECAST_KEY
    )
    return staging.stage_forecast(bronze.read_forecast(spark, path, HOURLY), HOURLY)


@query
def bronze_roundtrip_holidays(spark, sf_dir):
    path = scratch_path(spark, "bronze-holidays")
    bronze.land_reference(standins.holiday_feed(standins.order_demand(spark, sf_dir)), path)
    return staging.stage_holidays(bronze.read_holidays(spark, path))


@query
def layers_roundtrip(spark, sf_dir):
    """Staging view over landed files, then the hourly table built from it."""
    path = _landed_demand(spark, sf_dir)
    demand = as_view(staging.stage_demand(bronze.read_demand(spark, path, HOURLY), HOURLY), "demand")
    return as_table(staging.hourly_demand(demand, HOURLY), "demand_hourly", layer="silver_roundtrip")


def _land_all(spark, sf_dir) -> medallion.BronzePaths:
    inputs = by_event(spark, sf_dir)
    paths = medallion.BronzePaths(*(scratch_path(spark, f"bronze-{n}") for n in ("d", "f", "h")))
    ingest.ingest_demand(inputs.demand, paths.demand, HOURLY)
    bronze.land(bronze.forecast_envelopes(inputs.long), paths.forecast, bronze.FORECAST_KEY)
    ingest.ingest_holidays(standins.holiday_feed(inputs.demand), paths.holidays)
    return paths


@query
def bronze_to_gold(spark, sf_dir):
    """The mart table built from landed files through every layer."""
    medallion.build_silver(spark, _land_all(spark, sf_dir), HOURLY)
    return medallion.build_gold(spark, HOURLY)


@query
def check_all_layers(spark, sf_dir):
    medallion.build_silver(spark, _land_all(spark, sf_dir), HOURLY)
    medallion.build_gold(spark, HOURLY)
    return medallion.run_checks(spark, HOURLY)


@query
def check_observed(spark, sf_dir):
    """The same checks, seen while the layers are written; sequence and
    holidays, which need rows of their own, are checked on the stored tables."""
    on_demand = medallion.build_silver(spark, _land_all(spark, sf_dir), HOURLY, "silver_observed")
    _, seen = medallion.checked_gold(spark, HOURLY, silver="silver_observed", gold="gold_observed")
    hourly, holidays = (load(spark, t, "silver_observed") for t in ("demand_hourly", "bank_holidays"))
    rest = checks.hourly_checks(hourly, HOURLY).unionByName(checks.holiday_checks(holidays))
    return on_demand.unionByName(seen).unionByName(rest)


@query
def check_payload(spark, sf_dir):
    """Tripwires on payloads with faults: outturns above 10,000 are withheld,
    as are the settlement periods of error events and a division name."""
    demand = standins.event_demand(spark, sf_dir)
    outturn = F.col("initial_demand_outturn")
    faulty = demand.withColumns(
        {
            "initial_demand_outturn": F.when(outturn <= 10_000, outturn),
            "settlement_period": F.when(F.col("series_id") != "error", F.col("settlement_period")),
        }
    )
    payload = bronze.demand_envelopes(faulty, HOURLY)
    # envelopes without their key, and with nothing in them
    keyless = payload.where(F.dayofmonth("settlement_date") == 2).withColumn("data", F.lit(None).cast(payload.schema["data"].dataType))
    hollow = payload.where(F.dayofmonth("settlement_date") == 3).withColumn("data", F.slice("data", 1, 0))
    payload = payload.unionByName(keyless).unionByName(hollow)
    long = by_event(spark, sf_dir).long
    hour = F.hour("target_ts")
    long = long.withColumns(
        {
            "value": F.when(F.col("value") > 0, F.col("value")),
            "target_ts": F.when((hour != 3) | (F.col("N") != 1), F.col("target_ts")),
            "issue_ts": F.when((hour != 4) | (F.col("N") != 2), F.col("issue_ts")),
        }
    )
    feed = standins.holiday_feed(standins.order_demand(spark, sf_dir))
    results = [
        checks.payload_checks(payload, checks.DEMAND_REQUIRED, "demand"),
        checks.long_frame_checks(long),
        checks.holiday_payload_checks(feed),
    ]
    return results[0].unionByName(results[1]).unionByName(results[2])


@query
def malformed_files(spark, sf_dir):
    """Days whose files hold cut-off lines, found next to what can be read."""
    path = scratch_path(spark, "bronze-malformed")
    envelopes = bronze.demand_envelopes(standins.event_demand(spark, sf_dir), HOURLY)
    line = F.to_json(F.struct("data"))
    cut = (F.dayofmonth("settlement_date") == 2) & (F.col("data")[0]["settlementPeriod"] % 3 == 0)
    lines = envelopes.select(F.when(cut, F.substring(line, 1, 40)).otherwise(line).alias("value"), "settlement_date")
    lines.repartition("settlement_date").write.partitionBy("settlement_date").text(path)
    record = schemas.with_series(schemas.DEMAND_RECORD, HOURLY.series)
    found = bronze.malformed_files(spark, path, schemas.envelope(record, bronze.DEMAND_KEY))
    day = F.regexp_extract("file", "settlement_date=([0-9-]+)", 1).cast("date")
    return found.select(day.alias("settlement_date"), "n_malformed", "n_read")


# Backfill windows ----------------------------------------------------------


def _counted(orders: DataFrame, windows: DataFrame, start: dt.date, step: int) -> DataFrame:
    """Orders per window, whose starts are ``step`` days apart."""
    day = F.col("o_orderdate").cast("date")
    offset = F.floor(F.datediff(day, F.lit(start)) / step).cast("int") * step
    counts = orders.groupBy(F.date_add(F.lit(start), offset).alias("window_start")).agg(
        F.count("*").alias("n")
    )
    return windows.join(counts, "window_start", "left").fillna(0, ["n"])


@query
def window_tiles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    start, _ = order_span(spark, sf_dir)
    windows = tiling.date_windows(tiling.span_of(orders, "o_orderdate"), 28)
    return _counted(orders, windows, start, 28)


@query
def window_tiles_overlap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    start, end = order_span(spark, sf_dir)
    windows = tiling.overlapping_windows(tiling.span_of(orders, "o_orderdate"), 30, 7)
    issued = orders.where(F.col("o_orderdate").cast("date") <= F.lit(end - dt.timedelta(days=7)))
    return _counted(issued, windows, start, 23)


@query
def rows_per_issue(spark, sf_dir):
    return bronze.rows_per_issue(by_event(spark, sf_dir).long, HOURLY)


def _gappy_fetch(spark, sf_dir):
    """A fetch of the whole span that lacks an hour of one lead of one series
    every fifth day: its issue date is incomplete for that series alone."""
    inputs = by_event(spark, sf_dir)
    at = F.col("target_ts")
    gap = (F.col("series_id") == "error") & (F.col("N") == 3) & (F.hour(at) == 10) & (F.dayofmonth(at) % 5 == 0)
    path = scratch_path(spark, "bronze-complete")
    span = tiling.span_of(inputs.demand, "start_time").first()
    return path, bronze.land_complete_forecast(inputs.long.where(~gap), path, *span, HOURLY)


@query
def complete_partitions(spark, sf_dir):
    """Rows landed per issue date by a fetch with gaps."""
    path, _ = _gappy_fetch(spark, sf_dir)
    landed = bronze.read_forecast(spark, path, HOURLY)
    return landed.groupBy("issue_date").agg(F.sum(F.size("data")).alias("n"))


@query
def withheld_partitions(spark, sf_dir):
    """What the same fetch did not land."""
    return _gappy_fetch(spark, sf_dir)[1]


@query
def ingest_windows(spark, sf_dir):
    """Rows landed per issue date by a backfill in windows of ten days."""
    inputs = by_event(spark, sf_dir)
    path = scratch_path(spark, "bronze-windows")
    span = tiling.span_of(inputs.demand, "start_time")
    ingest.ingest_windows(inputs.wide, path, span, 10, HOURLY, VARIABLE)
    landed = bronze.read_forecast(spark, path, HOURLY)
    return landed.groupBy("issue_date").agg(F.sum(F.size("data")).alias("n"))


@query
def live_over_backfill(spark, sf_dir):
    """A live run of three days, 100 degrees warmer, merged into a backfill."""
    inputs = by_event(spark, sf_dir)
    path = scratch_path(spark, "bronze-merged")
    lo, hi = tiling.span_of(inputs.demand, "start_time").first()
    ingest.ingest_forecast(inputs.wide, path, lo, hi, HOURLY, VARIABLE)
    run = hi - dt.timedelta(days=HOURLY.max_lead)
    day = F.col("date").cast("date")
    near = inputs.wide.where((day >= F.lit(run)) & (day < F.lit(run + dt.timedelta(days=3))))
    live = near.select("series_id", "date", (F.col(VARIABLE) + 100).alias(VARIABLE))
    ingest.ingest_live(live, path, run, HOURLY, [VARIABLE])
    return staging.stage_forecast(bronze.read_forecast(spark, path, HOURLY), HOURLY)


# Mart ----------------------------------------------------------------------


@query
def mart_label(spark, sf_dir):
    inputs = by_event(spark, sf_dir)
    return features.attach_label(inputs.forecast, inputs.hourly, HOURLY)


@query
def mart_cutoff_lag(spark, sf_dir):
    inputs = by_event(spark, sf_dir)
    return features.attach_cutoff_lag(
        features.add_cutoff(inputs.forecast, HOURLY), inputs.hourly, HOURLY
    )


@query
def mart_anchors(spark, sf_dir):
    inputs = by_event(spark, sf_dir)
    return features.attach_anchors(
        features.add_cutoff(inputs.forecast, HOURLY), inputs.hourly, HOURLY
    )


@query
def mart_calendar(spark, sf_dir):
    inputs = by_priority(spark, sf_dir)
    return features.attach_calendar(inputs.forecast, inputs.holidays, DAILY)


@query
def mart_hinges(spark, sf_dir):
    return features.add_degree_hinges(by_event(spark, sf_dir).forecast, HOURLY)


@query
def mart_full(spark, sf_dir):
    return by_event(spark, sf_dir).mart()


@query
def mart_full_by_joins(spark, sf_dir):
    i = by_event(spark, sf_dir)
    return build_mart_by_joins(i.forecast, i.hourly, i.holidays, i.cfg)


@query
def mart_national(spark, sf_dir):
    return Inputs(standins.national_demand(spark, sf_dir), NATIONAL).mart()


@query
def mart_by_user(spark, sf_dir):
    """Every user's series against one shared forecast."""
    return by_user(spark, sf_dir).shared_mart()


@query
def mart_daily(spark, sf_dir):
    return by_priority(spark, sf_dir).mart()


@query
def mart_shared_weather(spark, sf_dir):
    """One forecast without series columns serving every series."""
    return by_event(spark, sf_dir).shared_mart()


@query
def mart_all_leads(spark, sf_dir):
    """Leads from -1, issued a day after their target, to 15."""
    inputs = by_event(spark, sf_dir)
    far = replace(HOURLY, max_lead=15)
    wide = standins.weather_wide(inputs.demand, far)
    long = reshape.melt_previous_runs(wide, far, reshape.variable_names(VARIABLE, far.max_lead))
    forecast = staging.pivot_forecast(long, HOURLY)
    late = forecast.where("lead_days = 0").withColumns(
        {"lead_days": F.lit(-1), "issue_ts": shift(F.col("issue_ts"), days=1)}
    )
    every = stored(forecast.unionByName(late), "forecast")
    return build_mart(every, inputs.hourly, inputs.holidays, HOURLY)


@query
def mart_summary(spark, sf_dir):
    """Rows and golden totals of the mart per lead."""
    mart = by_event(spark, sf_dir).mart()
    return mart.groupBy("lead_days").agg(
        F.count("*").alias("n"),
        F.sum("demand_lag_mw").alias("sum_demand_lag_mw"),
        F.round(F.sum("temperature_2m"), 4).alias("sum_temperature_2m"),
        F.count("lag_7d").alias("n_lag_7d"),
        F.count("lag_14d").alias("n_lag_14d"),
    )


@query
def local_calendar_dst(spark, sf_dir):
    """Local hour and weekday over years of clock changes."""
    at = shift(F.col("o_orderdate"), hours=(F.col("o_orderkey") % 24).cast("int"))
    local = to_local(at, HOURLY.local_tz)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            local.cast("date").alias("local_date"),
            F.hour(local).alias("hour"),
            iso_weekday(local).alias("day"),
        )
        .agg(F.count("*").alias("n"))
    )


@query
def rolling_known_past(spark, sf_dir):
    inputs = by_event(spark, sf_dir)
    rows = features.add_cutoff(inputs.forecast, HOURLY)
    rolled = tracking.rolling_known_past(rows, inputs.hourly, HOURLY, 24)
    return rolled.withColumn("mean_24h", F.round("mean_24h", 4))


# Checks --------------------------------------------------------------------


@query
def check_demand(spark, sf_dir):
    return checks.demand_checks(standins.event_demand(spark, sf_dir), HOURLY)


@query
def check_hourly(spark, sf_dir):
    return checks.hourly_checks(by_event(spark, sf_dir).hourly, HOURLY)


@query
def check_range(spark, sf_dir):
    """Hourly demand outside a range, row by row."""
    hourly = by_event(spark, sf_dir).hourly
    return checks.out_of_range(hourly, "avg_initial_demand_outturn", 1000, 20_000)


@query
def check_duplicates(spark, sf_dir):
    """Hours in which a user acted more than once: the grain check on raw rows."""
    events = table(spark, sf_dir, "events")
    hours = events.select("user_id", trunc_hour(F.col("ts")).alias("target_hour"))
    return checks.duplicates(hours, ["user_id", "target_hour"])


@query
def check_sequence(spark, sf_dir):
    """The hours that break the sequence, per user."""
    return checks.sequence_breaks(by_user(spark, sf_dir).hourly, HOURLY)


@query
def check_forecast(spark, sf_dir):
    return checks.forecast_checks(by_event(spark, sf_dir).forecast, HOURLY)


@query
def check_holidays(spark, sf_dir):
    return checks.holiday_checks(holidays_union(spark, sf_dir))


@query
def check_mart(spark, sf_dir):
    return checks.mart_checks(by_event(spark, sf_dir).mart(), HOURLY)


@query
def check_demand_faults(spark, sf_dir):
    """The same checks on demand with missing, negative and repeated outturns."""
    demand = standins.event_demand(spark, sf_dir)
    hour, day, outturn = F.hour("start_time"), F.dayofmonth("start_time"), F.col("initial_demand_outturn")
    spoilt = F.when((hour == 5) & (day == 2), None).when(hour == 3, -outturn).otherwise(outturn)
    bad = demand.withColumn("initial_demand_outturn", spoilt).unionByName(demand.where(day == 3))
    return checks.demand_checks(bad, HOURLY)


@query
def check_hourly_faults(spark, sf_dir):
    """Hours that are there twice, without a time, or missing."""
    hourly = by_event(spark, sf_dir).hourly
    at = F.col("target_hour")
    kept = hourly.where(F.hour(at) != 7)
    nameless = hourly.where(F.hour(at) == 8).withColumn("target_hour", F.lit(None).cast("timestamp_ntz"))
    return checks.hourly_checks(kept.unionByName(hourly.where(F.hour(at) == 9)).unionByName(nameless), HOURLY)


@query
def check_forecast_faults(spark, sf_dir):
    forecast = by_event(spark, sf_dir).forecast
    hot = (F.col("lead_days") == 3) & (F.hour("target_ts") == 10)
    bad = forecast.withColumn("temperature_2m", F.col("temperature_2m") + F.when(hot, 100).otherwise(0))
    return checks.forecast_checks(bad.unionByName(forecast.where("lead_days = 2")), HOURLY)


@query
def check_holiday_faults(spark, sf_dir):
    holidays = holidays_union(spark, sf_dir)
    return checks.holiday_checks(holidays.unionByName(holidays.where("division = 'scotland'")))


@query
def check_mart_faults(spark, sf_dir):
    """Nulls, swapped hinges, a lag read too late, and rows that are there twice."""
    mart = by_event(spark, sf_dir).mart()
    lead, hour = F.col("lead_days"), F.hour("target_ts")
    bad = mart.withColumns(
        {
            "demand_mw": F.when((lead == 0) & (hour == 4), None).otherwise(F.col("demand_mw")),
            "is_holiday": F.when((lead == 5) & (hour == 6), None).otherwise(F.col("is_holiday")),
            "temperature_2m": F.when((lead == 2) & (hour == 4), None).otherwise(F.col("temperature_2m")),
            "heating_degrees": F.when(lead == 3, 1.0).otherwise(F.col("heating_degrees")),
            "demand_lag_ts": F.when(lead == 4, F.col("target_ts")).otherwise(F.col("demand_lag_ts")),
        }
    )
    return checks.mart_checks(bad.unionByName(mart.where(lead == 1)), HOURLY)


@query
def forecast_pivot_copies(spark, sf_dir):
    """Records that were landed twice, the second time with lower values."""
    long = by_event(spark, sf_dir).long
    lower = long.where(F.col("N") < 3).withColumn("value", F.col("value") - 5)
    return staging.pivot_forecast(long.unionByName(lower), HOURLY)


@query
def check_leakage_mutated(spark, sf_dir):
    """The guard on a mart whose lag was read at the target itself."""
    inputs = by_event(spark, sf_dir)
    leaky = inputs.mart().withColumns(
        {"demand_lag_mw": F.col("demand_mw"), "demand_lag_ts": F.col("target_ts")}
    )
    return checks.leakage(leaky, HOURLY)


@query
def check_hinge_mutated(spark, sf_dir):
    """The sign check on a mart whose hinges were swapped."""
    mart = by_event(spark, sf_dir).mart()
    swapped = mart.withColumns(
        {"heating_degrees": F.col("cooling_degrees"), "cooling_degrees": F.col("heating_degrees")}
    )
    return checks.hinge_signs(swapped, HOURLY)


@query
def check_shipped_before_ordered(spark, sf_dir):
    """The leakage guard's counter-example: items read as forecasts issued on
    their order date for their ship date, many of them issued afterwards."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    pairs = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("target_ts"),
        F.col("o_orderdate").alias("issue_ts"),
        F.lit(0).alias("lead_days"),
    )
    none = F.lit(None)
    rows = features.add_cutoff(pairs, HOURLY).withColumns(
        {"demand_lag_ts": none.cast("timestamp_ntz")} | {c: none for c in HOURLY.anchor_columns}
    )
    return checks.leakage(rows, HOURLY).select("l_orderkey", "l_linenumber", "target_ts", "issue_ts")


# Folds, baseline, scores ---------------------------------------------------


@query
def folds(spark, sf_dir):
    return tiling.folds(holdout_span(spark, sf_dir), DAILY.max_lead)


def _fold_list(spark, sf_dir, months=HOLDOUT_MONTHS):
    return tiling.collect_folds(tiling.folds(holdout_span(spark, sf_dir, months), DAILY.max_lead))


@query
def fold_membership(spark, sf_dir):
    return tiling.fold_membership(mart_daily(spark, sf_dir), _fold_list(spark, sf_dir))


@query
def fold_rows(spark, sf_dir):
    """Rows of every fold's sides, told by series and lead."""
    rows = tiling.fold_rows(mart_daily(spark, sf_dir), _fold_list(spark, sf_dir))
    return rows.groupBy("test_start", "side", "series_id", "lead_days").agg(
        F.count("*").alias("n"), F.min("target_ts").alias("first_target"), F.max("target_ts").alias("last_target")
    )


@query
def fold_checks(spark, sf_dir):
    """Faults of the holdout's folds, three bad ones planted among them: one
    that trains up to its test, one that tests past the end, one without rows."""
    days = lambda n: dt.timedelta(days=n)
    last = order_span(spark, sf_dir)[1]
    first = holdout_start(last)
    planted = [
        tiling.Fold(first, first, first + days(28)),
        tiling.Fold(last - days(7), last, last + days(28)),
        tiling.Fold(dt.date(1900, 1, 1), dt.date(1900, 2, 1), dt.date(1900, 3, 1)),
    ]
    folds = [*_fold_list(spark, sf_dir), *planted]
    table = spark.createDataFrame(folds, "train_end date, test_start date, test_end date")
    members = tiling.fold_membership(mart_daily(spark, sf_dir), folds)
    return tiling.fold_faults(table, members, DAILY.max_lead, last)


def _baseline_rows(spark, sf_dir) -> DataFrame:
    return scoring.with_legal_anchor(scoring.with_baseline(mart_daily(spark, sf_dir), DAILY))


@query
def baseline_by_lead(spark, sf_dir):
    return rounded_errors(scoring.score_by_lead(_baseline_rows(spark, sf_dir)))


@query
def holdout_baseline(spark, sf_dir):
    _, last = order_span(spark, sf_dir)
    rows = scoring.holdout(mart_daily(spark, sf_dir), holdout_start(last), DAILY)
    scored = scoring.with_legal_anchor(scoring.with_baseline(rows, DAILY))
    return rounded_errors(scoring.score_by_lead(scored))


def _slice_query(key: str) -> Query:
    def run(spark, sf_dir):
        rows = scoring.with_slices(_baseline_rows(spark, sf_dir))
        return rounded_errors(scoring.error_by_slice(rows, key, scoring.BASELINE))

    return run


SLICE_QUERIES = {
    "error_by_holiday": "is_holiday",
    "error_by_band": "temp_band",
    "error_by_month": "month",
    "error_by_hour": "hour",
    "error_by_day": "day",
}
QUERIES.update({name: _slice_query(key) for name, key in SLICE_QUERIES.items()})


@query
def error_by_slices(spark, sf_dir):
    rows = scoring.with_slices(_baseline_rows(spark, sf_dir))
    return rounded_errors(scoring.error_by_slices(rows, scoring.BASELINE))


@query
def slice_totals(spark, sf_dir):
    rows = scoring.with_slices(_baseline_rows(spark, sf_dir))
    return scoring.slice_totals(scoring.slice_measures(rows, scoring.BASELINE))


def _two_predictors(spark, sf_dir) -> DataFrame:
    """Baseline and, as the model, the newest known demand."""
    return _baseline_rows(spark, sf_dir).withColumn(scoring.MODEL, F.col("demand_lag_mw"))


@query
def score_compare(spark, sf_dir):
    return rounded_errors(scoring.improvement(_two_predictors(spark, sf_dir)))


@query
def ablation_compare(spark, sf_dir):
    rows = _two_predictors(spark, sf_dir)
    full, other = (scoring.score_by_lead(rows, c) for c in (scoring.MODEL, scoring.BASELINE))
    return rounded_errors(scoring.ablation_difference(full, other))


@query
def mae_mape(spark, sf_dir):
    scores = scoring.absolute_errors_by_lead(_baseline_rows(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 4) for c in ("mae", "mape_pct")})


@query
def accuracy_tracker(spark, sf_dir):
    """Rolling four-week error of the stored baseline forecasts."""
    inputs = by_priority(spark, sf_dir)
    mart = scoring.with_legal_anchor(scoring.with_baseline(inputs.mart(), DAILY))
    forecasts = mart.select("series_id", "target_ts", "lead_days", scoring.BASELINE)
    tracked = tracking.with_actuals(forecasts, inputs.hourly, DAILY)
    over_time = tracking.accuracy_over_time(tracked, scoring.BASELINE, 28)
    return over_time.withColumn("rmse", F.round("rmse", 4))


@query
def accuracy_incremental(spark, sf_dir):
    """The same error from stored daily sums, brought up to date by three
    batches of actuals: most of the past, the holdout, and days that came late."""
    inputs = by_priority(spark, sf_dir)
    mart = scoring.with_legal_anchor(scoring.with_baseline(inputs.mart(), DAILY))
    forecasts = stored(mart.select("series_id", "target_ts", "lead_days", scoring.BASELINE), "forecasts")
    hourly = stored(inputs.hourly, "hourly")
    path = scratch_path(spark, "accuracy")
    day = F.col("target_hour").cast("date")
    recent, late = day >= F.lit(holdout_start(order_span(spark, sf_dir)[1])), F.dayofmonth(day) % 7 == 0
    known = F.lit(False)
    for batch in (~recent & ~late, recent, ~recent & late):
        known = known | batch
        tracking.update_accuracy(path, forecasts, hourly.where(known), hourly.where(batch), DAILY, scoring.BASELINE)
    return tracking.stored_accuracy(spark, path, 28).withColumn("rmse", F.round("rmse", 4))


@query
def promotion(spark, sf_dir):
    rows = _baseline_rows(spark, sf_dir)
    _, last = order_span(spark, sf_dir)
    # the champion never served the longest lead, the challenger not the next one
    challenger = rows.withColumn("prediction", F.col("demand_lag_mw")).where("lead_days <> 6")
    champion = rows.withColumn("prediction", F.col(scoring.BASELINE)).where("lead_days <> 7")
    result = tracking.promotion(champion, challenger, holdout_start(last, 3), DAILY, "prediction")
    return result.withColumns({c: F.round(c, 4) for c in ("rmse_champion", "rmse_challenger")})


# Models --------------------------------------------------------------------


def _training(spark, sf_dir):
    frame = walk_forward.training_frame(mart_daily(spark, sf_dir), DAILY)
    return frame, _fold_list(spark, sf_dir), DAILY


@query
def walk_forward_gbt(spark, sf_dir):
    return walk_forward.walk_forward(*_training(spark, sf_dir), params=QUICK, parallelism=8)


@query
def ablation_gbt(spark, sf_dir):
    return walk_forward.ablation(*_training(spark, sf_dir), params=QUICK, parallelism=8)


@query
def seed_sweep_gbt(spark, sf_dir):
    return walk_forward.seed_sweep(*_training(spark, sf_dir), params=QUICK_BAGGED, parallelism=8)


@query
def walk_forward_rows(spark, sf_dir):
    """What of the predictions SQL can state: which rows, and what they are held against."""
    rows = walk_forward_gbt(spark, sf_dir).where(F.col(scoring.MODEL).isNotNull())
    return rows.select("series_id", "target_ts", "lead_days", "demand_mw", scoring.BASELINE)


@query
def ablation_rows(spark, sf_dir):
    """Rows and mean demand that either side of the ablation was scored on."""
    return ablation_gbt(spark, sf_dir).select("lead_days", "n_full", "n_ablated", "mean_demand_full", "mean_demand_ablated")


@query
def serving_features(spark, sf_dir):
    """Features of the last complete issue date, whose targets need no label."""
    inputs = by_priority(spark, sf_dir)
    run_date = order_span(spark, sf_dir)[1] - dt.timedelta(days=DAILY.max_lead)
    rows = serving_rows(inputs.forecast, inputs.hourly, inputs.holidays, DAILY)
    return rows.where(F.col("issue_ts") == F.lit(run_date).cast("timestamp_ntz"))


@query
def batch_forecast(spark, sf_dir):
    """A model fitted on the past and stored; loaded by run date, it forecasts
    the last complete issue date."""
    inputs = by_priority(spark, sf_dir)
    run_date = order_span(spark, sf_dir)[1] - dt.timedelta(days=DAILY.max_lead)
    frame = walk_forward.training_frame(inputs.mart(), DAILY)
    models, forecasts = scratch_path(spark, "models"), scratch_path(spark, "forecasts")
    past = tracking.published(frame, run_date, DAILY)
    tracking.save_model(walk_forward.fit(past, walk_forward.FEATURES, QUICK), models, "v1", run_date, DAILY, QUICK)
    _, model = tracking.load_model(spark, models, run_date, DAILY)
    rows = serving_rows(inputs.forecast, inputs.hourly, inputs.holidays, DAILY)
    tracking.store_forecasts(tracking.batch_forecast(model, rows, run_date, DAILY), forecasts)
    return spark.read.parquet(forecasts)


@query
def batch_forecast_rows(spark, sf_dir):
    """Which forecasts the stored model makes."""
    rows = batch_forecast(spark, sf_dir).where(F.col(scoring.MODEL).isNotNull())
    return rows.select("series_id", "target_ts", "lead_days", "issue_date")


@query
def sweep_rows(spark, sf_dir):
    """Rows and mean demand that every seed's two runs were scored on."""
    columns = ("n_full", "n_ablated", "mean_demand_full", "mean_demand_ablated")
    return seed_sweep_gbt(spark, sf_dir).select("seed", "lead_days", *columns)


@query
def seed_noise(spark, sf_dir):
    """Mean, deviation and spread over the seeds, per lead and measure."""
    return walk_forward.noise_floor(seed_sweep_gbt(spark, sf_dir))


@query
def model_inputs(spark, sf_dir):
    """What goes into a fit: every encoded column, with its key."""
    frame = walk_forward.encoded_frame(mart_daily(spark, sf_dir), DAILY)
    return frame.select("series_id", "target_ts", "lead_days", *walk_forward.input_columns(walk_forward.FEATURES))
