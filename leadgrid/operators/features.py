"""The mart's steps as separate operators.

Each is a left join or a projection that can be used alone; ``plans.mart``
builds the same columns with fewer shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.measures import gated, hinge
from leadgrid.functions.temporal import iso_weekday, shift, to_local, trunc_hour


#: dates that are broadcast: a thousand years of nothing but holidays
HOLIDAY_DATES = 366 * 1000


def broadcast_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _lookup(
    rows: DataFrame, hourly: DataFrame, cfg: PitConfig, key: str, value: str, hour: str | None = None
) -> DataFrame:
    """Left join the hourly value at the instant in column ``key``."""
    found = [F.col("avg_initial_demand_outturn").alias(value)]
    if hour:
        found.append(F.col("target_hour").alias(hour))
    side = hourly.select(*cfg.series, F.col("target_hour").alias(key), *found)
    return rows.join(side, [*cfg.series, key], "left")


def attach_label(forecast: DataFrame, hourly: DataFrame, cfg: PitConfig) -> DataFrame:
    """Demand at the target hour."""
    return _lookup(forecast, hourly, cfg, "target_ts", "demand_mw")


def add_cutoff(rows: DataFrame, cfg: PitConfig) -> DataFrame:
    """Latest instant whose demand was published at prediction time."""
    cutoff = shift(F.col("target_ts"), days=-F.col("lead_days"), hours=-cfg.publication_lag_hours)
    return rows.withColumn("cutoff", cutoff)


def attach_cutoff_lag(rows: DataFrame, hourly: DataFrame, cfg: PitConfig) -> DataFrame:
    """Demand at the cutoff's hour, and that hour as provenance.

    Equality rather than as-of: on a gap the value is null, not an older one.
    """
    keyed = rows.withColumn("_key", trunc_hour(F.col("cutoff")))
    return _lookup(keyed, hourly, cfg, "_key", "demand_lag_mw", "demand_lag_ts").drop("_key")


def attach_anchors(rows: DataFrame, hourly: DataFrame, cfg: PitConfig) -> DataFrame:
    """Demand whole weeks before the target, null where not yet knowable."""
    for name, hours in cfg.anchor_columns.items():
        keyed = rows.withColumn("_key", shift(F.col("target_ts"), hours=-hours))
        found = _lookup(keyed, hourly, cfg, "_key", "_value")
        value = gated(F.col("_value"), F.col("_key"), F.col("cutoff"))
        rows = found.withColumn(name, value).drop("_key", "_value")
    return rows


def attach_calendar(rows: DataFrame, holidays: DataFrame, cfg: PitConfig) -> DataFrame:
    """Local hour, local weekday and holiday flag.

    The division is chosen before the left join, so other divisions' holidays
    never match and unmatched rows stay; a date counts once, so copies of a
    holiday do not multiply rows. Dates are counted first: a year has 366 at
    most, so they are broadcast unless the table is not what it should be.
    """
    local = to_local(F.col("target_ts"), cfg.local_tz)
    dates = broadcast_small(
        holidays.where(F.col("division") == cfg.holiday_division)
        .select(F.col("holiday_date").alias("_local_date"))
        .distinct(),
        HOLIDAY_DATES,
    ).withColumn("_holiday", F.lit(True))
    return (
        rows.withColumn("_local", local)
        .withColumns(
            {
                "hour": F.hour("_local"),
                "day": iso_weekday(F.col("_local")),
                "_local_date": F.col("_local").cast("date"),
            }
        )
        .join(dates, "_local_date", "left")
        .withColumn("is_holiday", F.col("_holiday").isNotNull())
        .drop("_local", "_local_date", "_holiday")
    )


def add_degree_hinges(rows: DataFrame, cfg: PitConfig) -> DataFrame:
    t, base = F.col("temperature_2m"), F.lit(cfg.base_temperature)
    return rows.withColumns({"heating_degrees": hinge(base - t), "cooling_degrees": hinge(t - base)})


def mart_columns(cfg: PitConfig) -> list[str]:
    return [
        *cfg.series, "target_ts", "hour", "day", "lead_days", "demand_mw", "demand_lag_mw",
        *cfg.anchor_columns, "is_holiday", "temperature_2m", "heating_degrees",
        "cooling_degrees", "cutoff", "issue_ts", "demand_lag_ts",
    ]


def keep_trainable(rows: DataFrame) -> DataFrame:
    """Rows that have both a label and a lagged demand."""
    return rows.dropna(subset=["demand_mw", "demand_lag_mw"])
