"""Bronze envelopes to typed Silver rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.temporal import epoch_hour, from_epoch_hour, parse_iso
from leadgrid.operators.reshape import LEAD_SUFFIX

# Feed key -> division label.
DIVISIONS = {"england-and-wales": "eng&wales", "scotland": "scotland"}


def records(bronze: DataFrame) -> DataFrame:
    """One row per record inside the ``data`` envelopes."""
    return bronze.select(F.inline("data"))


def stage_demand(bronze: DataFrame, cfg: PitConfig) -> DataFrame:
    return records(bronze).select(
        *cfg.series,
        parse_iso(F.col("publishTime")).alias("publish_time"),
        parse_iso(F.col("startTime")).alias("start_time"),
        F.to_date("settlementDate").alias("settlement_date"),
        F.col("settlementPeriod").alias("settlement_period"),
        F.col("initialDemandOutturn").alias("initial_demand_outturn"),
        F.col("initialTransmissionSystemDemandOutturn").alias(
            "initial_transmission_system_demand_outturn"
        ),
    )


def stage_forecast(bronze: DataFrame, cfg: PitConfig, variables=("temperature_2m",)) -> DataFrame:
    rows = records(bronze).withColumns(
        {"target_ts": parse_iso(F.col("target_ts")), "issue_ts": parse_iso(F.col("issue_ts"))}
    )
    return pivot_forecast(rows, cfg, variables)


def pivot_forecast(long: DataFrame, cfg: PitConfig, variables=("temperature_2m",)) -> DataFrame:
    """Long records to one column per variable, duplicates merged by max.

    Live records carry no lead; it is the whole days from issue to target,
    which equals the recorded lead wherever one is recorded. Records are dealt
    out by series and target, which also serves a later join on these: a group
    holds the few leads of one hour, so there is little to combine before.
    """
    lead = F.datediff(F.col("target_ts").cast("date"), F.col("issue_ts").cast("date"))
    if "N" in long.columns:
        lead = F.coalesce(F.col("N"), lead)
    base = F.regexp_replace("variable", LEAD_SUFFIX, "")
    rows = long.withColumns({"lead_days": lead, "base": base})
    if cfg.series:
        partitions = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(partitions, *cfg.series, "target_ts")
    return (
        rows
        .groupBy(*cfg.series, "target_ts", "issue_ts", "lead_days")
        .agg(*[F.max(F.when(F.col("base") == v, F.col("value"))).alias(v) for v in variables])
    )


def stage_holidays(bronze: DataFrame) -> DataFrame:
    """Holidays of the divisions in use, each tagged with its label."""
    parts = [
        bronze.select(F.inline(F.col(f"`{key}`.events"))).select(
            F.to_date("date").alias("holiday_date"), "title", F.lit(label).alias("division")
        )
        for key, label in DIVISIONS.items()
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def hourly_demand(demand: DataFrame, cfg: PitConfig) -> DataFrame:
    """Half hours averaged to hours labelled by their start.

    Rows are grouped by an integer hour, which becomes a timestamp afterwards.
    The aggregate combines map-side, so a series holding a large share of the
    input reaches the shuffle as at most one row per hour and task.
    """
    hours = demand.groupBy(*cfg.series, epoch_hour(F.col("start_time")).alias("_hour")).agg(
        F.avg("initial_demand_outturn").alias("avg_initial_demand_outturn")
    )
    at = from_epoch_hour(F.col("_hour")).alias("target_hour")
    return hours.select(*cfg.series, at, "avg_initial_demand_outturn")


def half_hours(demand: DataFrame, cfg: PitConfig) -> DataFrame:
    """Rows per (series, start_time): their number, and sum and number of the
    known outturns, from which ``hours_of`` makes hours."""
    value = F.col("initial_demand_outturn")
    return demand.groupBy(*cfg.series, "start_time").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"), F.count(value).alias("_known")
    )


def hours_of(halves: DataFrame, cfg: PitConfig) -> DataFrame:
    """As ``hourly_demand``, from half hours that were counted on the way."""
    hours = halves.groupBy(*cfg.series, epoch_hour(F.col("start_time")).alias("_hour")).agg(
        (F.sum("_sum").cast("double") / F.nullif(F.sum("_known"), F.lit(0))).alias("avg_initial_demand_outturn")
    )
    at = from_epoch_hour(F.col("_hour")).alias("target_hour")
    return hours.select(*cfg.series, at, "avg_initial_demand_outturn")
