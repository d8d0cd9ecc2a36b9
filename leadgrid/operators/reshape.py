"""From a fetched wide frame to long, issue-stamped forecast records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.temporal import from_epoch_seconds, shift, trunc_day

# Fixed value: how a column's name tells its lead.
LEAD_SUFFIX = r"_previous_day(\d+)$"


def variable_names(variable: str, max_lead: int) -> list[str]:
    """The variable as issued on the day, then as issued 1..n days before."""
    return [variable] + [f"{variable}_previous_day{n}" for n in range(1, max_lead + 1)]


def time_axis(responses: DataFrame, values: dict[str, str], keys: list[str]) -> DataFrame:
    """Rows of a regular, right-open axis with one column per variable.

    ``responses`` has ``start``, ``end`` and ``step`` in epoch seconds and one
    array column per variable; ``values`` maps array column -> output column.
    """
    axis = F.sequence("start", F.col("end") - F.col("step"), F.col("step"))
    on_time = F.when(F.col("start") < F.col("end"), axis)
    zipped = F.arrays_zip(on_time.alias("seconds"), *[F.col(c).alias(n) for c, n in values.items()])
    return responses.select(*keys, F.inline(zipped)).select(
        *keys, from_epoch_seconds(F.col("seconds")).alias("date"), *values.values()
    )


def lead_of(variable: Column) -> Column:
    """The n of ``..._previous_dayN``; 0 without the suffix."""
    digits = F.nullif(F.regexp_extract(variable, LEAD_SUFFIX, 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def melt_previous_runs(wide: DataFrame, cfg: PitConfig, variables: list[str]) -> DataFrame:
    """Melt the issue axis: every column is the same variable at another lead,
    so each row's issue time follows from its column name.

    The lead is taken from the name as a literal and folded when the query is
    planned, so no row pays for the pattern.
    """
    records = [
        F.struct(
            F.lit(name).alias("variable"),
            F.col(name).cast("double").alias("value"),
            lead_of(F.lit(name)).alias("N"),
        )
        for name in variables
    ]
    long = wide.select(*cfg.series, F.col("date").alias("target_ts"), F.inline(F.array(*records)))
    return long.withColumn("issue_ts", shift(trunc_day(F.col("target_ts")), days=-F.col("N")))


def melt_live_run(
    wide: DataFrame, cfg: PitConfig, variables: list[str], run_date: dt.date | Column
) -> DataFrame:
    """Melt the variable axis of one run: all rows carry the run's date."""
    issued = run_date if isinstance(run_date, Column) else F.lit(run_date)
    long = wide.unpivot([*cfg.series, "date"], variables, "variable", "value")
    return long.withColumnRenamed("date", "target_ts").withColumn(
        "issue_ts", issued.cast("date").cast("timestamp_ntz")
    )
