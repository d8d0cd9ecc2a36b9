"""Small hand-made series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from leadgrid.config import PitConfig
from leadgrid.operators import reshape

CFG = PitConfig()
H = dt.timedelta(hours=1)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def hours(start: str, n: int, step: int = 1) -> list[dt.datetime]:
    return [at(start) + i * step * H for i in range(n)]


def hourly_frame(spark, times, value=lambda t: float(t.timestamp() // 3600 % 1000 + 1)) -> DataFrame:
    rows = [(t, value(t)) for t in times]
    return spark.createDataFrame(rows, "target_hour timestamp_ntz, avg_initial_demand_outturn double")


def forecast_frame(spark, times, leads=range(8), temperature=lambda t, n: 10.0 + n) -> DataFrame:
    rows = [
        (t, dt.datetime.combine(t.date(), dt.time()) - n * 24 * H, n, temperature(t, n))
        for t in times
        for n in leads
    ]
    return spark.createDataFrame(
        rows,
        "target_ts timestamp_ntz, issue_ts timestamp_ntz, lead_days int, temperature_2m double",
    )


def holiday_frame(spark, rows=()) -> DataFrame:
    return spark.createDataFrame(
        [(dt.date.fromisoformat(d), "holiday", div) for d, div in rows],
        "holiday_date date, title string, division string",
    )


def long_frame(spark, first: str, days: int) -> DataFrame:
    """Melted records of a fetch of ``days`` whole target days."""
    names = reshape.variable_names("temperature_2m", 7)
    rows = [(t, *[float(n) for n in range(8)]) for t in hours(first, 24 * days)]
    schema = "date timestamp_ntz, " + ", ".join(f"{n} double" for n in names)
    return reshape.melt_previous_runs(spark.createDataFrame(rows, schema), CFG, names)
