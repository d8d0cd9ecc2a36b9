"""Demand, forecast and holiday inputs derived from the given tables.

``events`` gives half-hourly series (by event type or by user), ``orders`` a
daily series per priority long enough for folds and clock changes. Outturns
are integers, as in the real feed, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadgrid import schemas
from leadgrid.config import PitConfig
from leadgrid.functions.temporal import (
    epoch_hour,
    from_half_hour_slot,
    half_hour_slot,
    shift,
)
from leadgrid.operators.reshape import time_axis, variable_names

VARIABLE = "temperature_2m"
HOURLY = PitConfig(series=("series_id",))
NATIONAL = PitConfig()
DAILY = PitConfig(series=("series_id",), publication_lag_hours=24)

# Days of the month that stand in for holidays, by feed key.
HOLIDAY_DAYS = {"england-and-wales": (1, 15), "scotland": (1, 2), "northern-ireland": (17,)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _demand(rows: DataFrame, series: Column, ts: Column, amount: Column) -> DataFrame:
    sums = rows.groupBy(series.alias("series_id"), half_hour_slot(ts).alias("_slot")).agg(
        F.sum(F.round(amount).cast("bigint")).alias("initial_demand_outturn"),
        F.count("*").alias("_n"),
    )
    at = F.col("start_time")
    return sums.withColumn("start_time", from_half_hour_slot(F.col("_slot"))).select(
        "series_id",
        shift(at, hours=1).alias("publish_time"),
        "start_time",
        at.cast("date").alias("settlement_date"),
        (F.hour(at) * 2 + F.floor(F.minute(at) / 30) + 1).cast("int").alias("settlement_period"),
        "initial_demand_outturn",
        (F.col("initial_demand_outturn") + F.col("_n")).alias(
            "initial_transmission_system_demand_outturn"
        ),
    )


def event_demand(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _demand(events, F.col(key).cast("string"), F.col("ts"), F.col("value") * 100)


def order_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return _demand(orders, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"))


def national_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series without a key."""
    events = table(spark, sf_dir, "events")
    return _demand(events, F.lit("all"), F.col("ts"), F.col("value") * 100).drop("series_id")


def weather_responses(demand: DataFrame, cfg: PitConfig, step_hours: int) -> DataFrame:
    """One response per series: axis bounds and a value array per variable.

    Arrays are as long as the series' calendar, not as its row count. The few
    spans are spread over all shuffle partitions before they grow into arrays;
    by their own size they would be packed into one.
    """
    hour = epoch_hour(F.col("start_time"))
    step = 3600 * step_hours
    spans = demand.groupBy(*cfg.series).agg(
        (F.min(hour) * 3600).alias("start"), (F.max(hour) * 3600 + step).alias("end")
    )
    if cfg.series:
        partitions = int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spans = spans.repartition(partitions)
    axis = F.sequence("start", F.col("end") - step, F.lit(step).cast("bigint"))

    def reading(lead: int) -> Column:
        return F.transform(axis, lambda s: (F.floor(s / 3600) * 7 + lead * 13) % 400 / 10 - 10)

    values = [reading(n).alias(f"v{n}") for n in cfg.leads]
    return spans.select(*cfg.series, "start", "end", F.lit(step).cast("bigint").alias("step"), *values)


def weather_wide(demand: DataFrame, cfg: PitConfig, step_hours: int = 1) -> DataFrame:
    """Fetched frame: ``date`` and one column per lead of the temperature."""
    names = {f"v{n}": name for n, name in enumerate(variable_names(VARIABLE, cfg.max_lead))}
    return time_axis(weather_responses(demand, cfg, step_hours), names, list(cfg.series))


def holiday_feed(demand: DataFrame) -> DataFrame:
    """Holiday documents over the demand's calendar, one document a year."""
    dates = demand.select(F.col("start_time").cast("date").alias("d")).distinct()
    event = F.struct(
        F.concat(F.lit("Holiday on the "), F.dayofmonth("d")).alias("title"),
        F.col("d").cast("string").alias("date"),
        F.lit("").alias("notes"),
        (F.dayofmonth("d") == 1).alias("bunting"),
    )
    divisions = [
        F.struct(
            F.lit(key).alias("division"),
            F.collect_list(F.when(F.dayofmonth("d").isin(*days), event)).alias("events"),
        ).alias(key)
        for key, days in HOLIDAY_DAYS.items()
    ]
    return dates.groupBy(F.year("d").alias("_year")).agg(*divisions).select(
        *[F.col(f"`{c}`") for c in schemas.HOLIDAY_FEED.names]
    )
