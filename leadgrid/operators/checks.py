"""Data-quality checks. A check is a query for violations and passes when it
returns no row; ``count_violations`` turns several into one table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.temporal import shift
from leadgrid.operators.lookups import over_hours

# Plausible air temperature in degrees Celsius.
TEMPERATURE_RANGE = (-30, 50)

# Keys that the feeds must have.
DEMAND_REQUIRED = ("settlementDate", "settlementPeriod", "initialDemandOutturn")
FORECAST_REQUIRED = ("target_ts", "issue_ts", "value")
HOLIDAY_REQUIRED = ("title", "date")

STAGED_DEMAND_NOT_NULL = ("start_time", "initial_demand_outturn")
MART_NOT_NULL = (
    "target_ts", "lead_days", "demand_mw", "demand_lag_mw", "is_holiday", "temperature_2m",
)


def row_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check, n_violations) for several row predicates from a single pass."""
    counted = df.agg(*[F.count_if(rule).alias(f"_{i}") for i, rule in enumerate(rules.values())])
    pairs = [
        F.struct(F.lit(name).alias("check"), F.col(f"_{i}").alias("n_violations"))
        for i, name in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*pairs)))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once. Copies are counted map-side first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def grain_and_row_counts(
    df: DataFrame, grain: str, keys: list[str], rules: Mapping[str, Column], ignore_null: str | None = None
) -> DataFrame:
    """(check, n_violations) for a unique key and row predicates together.

    Rows are counted per key and the counts summed up, so an expensive input
    is evaluated once for all of them. ``ignore_null`` names a key column
    whose nulls are not held to be copies of each other.
    """
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        *[F.count_if(rule).alias(f"_{i}") for i, rule in enumerate(rules.values())],
    )
    copied = F.col("_n") > 1
    if ignore_null:
        copied = copied & F.col(ignore_null).isNotNull()
    totals = per_key.agg(
        F.count_if(copied).alias("_grain"),
        *[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(rules))],
    )
    named = {grain: "_grain"} | {name: f"_{i}" for i, name in enumerate(rules)}
    pairs = [
        F.struct(F.lit(name).alias("check"), F.col(c).alias("n_violations")) for name, c in named.items()
    ]
    return totals.select(F.inline(F.array(*pairs)))


def sequence_breaks(hourly: DataFrame, cfg: PitConfig) -> DataFrame:
    """Hours that do not follow their series' previous hour.

    Such an hour has no row one hour before it and is not the series' first,
    which is the first of those without a row before them.
    """
    key = [*cfg.series, "target_hour"]
    seen = over_hours(hourly.select(*key), cfg.series, {"_before": (F.count("*"), 1, 1)})
    starts = seen.where(F.col("_before") == 0).select(*key)
    first = starts.groupBy(*cfg.series).agg(F.min("target_hour").alias("target_hour"))
    return starts.join(first, key, "left_anti")


def range_rule(column: str, lo: float, hi: float) -> Column:
    return (F.col(column) < lo) | (F.col(column) > hi)


def out_of_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.where(range_rule(column, lo, hi))


def not_positive(demand: DataFrame) -> DataFrame:
    return demand.where(F.col("initial_demand_outturn") <= 0)


def leakage_rule(cfg: PitConfig) -> Column:
    """True where a predictor was read from later than it may have been.

    Every predictor is held against the timestamp it came from: lagged demand
    and anchors against the cutoff, weather against the prediction time.
    """
    cutoff = F.col("cutoff")
    predicted_at = shift(F.col("target_ts"), days=-F.col("lead_days"))
    rules = [
        F.col("demand_lag_ts") > cutoff,
        F.col("issue_ts") > predicted_at,
        cutoff > predicted_at,
    ]
    for name, hours in cfg.anchor_columns.items():
        read_at = shift(F.col("target_ts"), hours=-hours)
        rules.append((read_at > cutoff) & F.col(name).isNotNull())
    return reduce(Column.__or__, rules)


def leakage(mart: DataFrame, cfg: PitConfig) -> DataFrame:
    return mart.where(leakage_rule(cfg))


def hinge_rule(cfg: PitConfig) -> Column:
    """True where a degree hinge is on the wrong side of the base."""
    t, base = F.col("temperature_2m"), F.lit(cfg.base_temperature)
    return ((F.col("heating_degrees") > 0) & (t > base)) | ((F.col("cooling_degrees") > 0) & (t < base))


def hinge_signs(mart: DataFrame, cfg: PitConfig) -> DataFrame:
    return mart.where(hinge_rule(cfg))


def count_violations(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, n_violations), one row per named query."""
    counts = [
        df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
        for name, df in checks.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _null_rules(prefix: str, columns: Iterable[str]) -> dict[str, Column]:
    return {f"{prefix}.{c} not null": F.col(c).isNull() for c in columns}


def demand_rules() -> dict[str, Column]:
    return _null_rules("demand", STAGED_DEMAND_NOT_NULL) | {"demand positive": F.col("initial_demand_outturn") <= 0}


def demand_checks(demand: DataFrame, cfg: PitConfig) -> DataFrame:
    keys = [*cfg.series, "start_time"]
    return grain_and_row_counts(demand, "demand.start_time unique", keys, demand_rules(), "start_time")


def hourly_checks(hourly: DataFrame, cfg: PitConfig) -> DataFrame:
    rules = _null_rules("demand_hourly", ["target_hour"])
    keys = [*cfg.series, "target_hour"]
    rows = grain_and_row_counts(hourly, "demand_hourly.target_hour unique", keys, rules, "target_hour")
    breaks = {"demand_hourly.target_hour sequential": sequence_breaks(hourly, cfg)}
    return rows.unionByName(count_violations(breaks))


def forecast_rules() -> dict[str, Column]:
    return {"weather_forecast temperature range": range_rule("temperature_2m", *TEMPERATURE_RANGE)}


def forecast_checks(forecast: DataFrame, cfg: PitConfig) -> DataFrame:
    keys = [*(c for c in cfg.series if c in forecast.columns), "target_ts", "issue_ts"]
    return grain_and_row_counts(forecast, "weather_forecast grain unique", keys, forecast_rules())


def holiday_checks(holidays: DataFrame) -> DataFrame:
    keys = ["holiday_date", "division"]
    return grain_and_row_counts(holidays, "bank_holidays grain unique", keys, {})


def mart_rules(cfg: PitConfig) -> dict[str, Column]:
    return _null_rules("demand_features", MART_NOT_NULL) | {
        "demand_features leakage": leakage_rule(cfg),
        "demand_features hinge sign": hinge_rule(cfg),
    }


def mart_checks(mart: DataFrame, cfg: PitConfig) -> DataFrame:
    """All mart checks from one evaluation of the mart."""
    return grain_and_row_counts(mart, "demand_features grain unique", cfg.grain, mart_rules(cfg))


COPY = "_copy"


def mark_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``COPY``, true on one row of each key that occurs more than
    once. Rows that are dealt out by some of the keys are not shuffled."""
    return df.withColumn(COPY, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 2)


class Watch:
    """Counts gathered while a frame is used for something else, such as a
    write, so that checks cost no evaluation of their own.

    Use ``df`` in the place of the frame; ``results`` waits for the action. A
    task that runs again may count a violation twice, but none is missed: where
    no row comes out further on, adaptive execution may put an empty relation
    in the place of the plan, counts included, and the frame is then counted by
    itself.
    """

    def __init__(self, df: DataFrame, rules: Mapping[str, Column], aggregates: Mapping[str, Column] | None = None):
        counts = {name: F.count_if(rule) for name, rule in rules.items()} | dict(aggregates or {})
        self.names = list(counts)
        self._seen, self._found = Observation(), None
        totals = [count.alias(f"_{i}") for i, count in enumerate(counts.values())]
        self._totals = df.agg(*totals)
        self.df = df.observe(self._seen, *totals)

    def _observed(self) -> dict:
        """What the action counted; empty if its plan ended without the counts."""
        try:
            return self._seen.get
        except Py4JJavaError:
            return {}

    def counts(self) -> list[tuple[str, int]]:
        if self._found is None:
            self._found = self._observed() or self._totals.first().asDict()
        return [(name, self._found[f"_{i}"] or 0) for i, name in enumerate(self.names)]

    def results(self, spark: SparkSession) -> DataFrame:
        """(check, n_violations)."""
        return spark.createDataFrame(self.counts(), "check string, n_violations bigint")


def enforce_watched(*watches: Watch) -> None:
    """Raise if any watch saw a violation."""
    failed = [(name, n) for watch in watches for name, n in watch.counts() if n]
    if failed:
        raise ValueError("; ".join(f"{name}: {n}" for name, n in failed))


def _lacks(key: str, record: Column) -> Column:
    return record[key].isNull()


def payload_counts(required: Iterable[str], name: str) -> dict[str, Column]:
    """Aggregates over landed envelopes: missing or empty ``data``, missing keys."""
    lacking = {c: F.coalesce(F.size(F.filter("data", partial(_lacks, c))), F.lit(0)) for c in required}
    counts = {
        "no payload": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0),
        "no data key": F.count_if(F.col("data").isNull()),
        "empty data": F.count_if(F.size("data") == 0),
        **{f"missing {c}": F.coalesce(F.sum(n), F.lit(0)) for c, n in lacking.items()},
    }
    return {f"{name} {fault}": n.cast("bigint") for fault, n in counts.items()}


def payload_checks(envelopes: DataFrame, required: Iterable[str], name: str) -> DataFrame:
    """Tripwire on landed envelopes, a row for each of ``payload_counts``."""
    counts = payload_counts(required, name)
    totals = envelopes.agg(*[n.alias(f"_{i}") for i, n in enumerate(counts.values())])
    pairs = [
        F.struct(F.lit(check).alias("check"), F.col(f"_{i}").alias("n_violations")) for i, check in enumerate(counts)
    ]
    return totals.select(F.inline(F.array(*pairs)))


def long_frame_counts(name: str = "forecast") -> dict[str, Column]:
    """Aggregates over melted records: whether there are none, and what they lack."""
    empty = F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint")
    lacking = {f"{name} missing {c}": F.count_if(F.col(c).isNull()) for c in FORECAST_REQUIRED}
    return {f"{name} empty": empty} | lacking


def long_frame_checks(long: DataFrame, name: str = "forecast") -> DataFrame:
    """Tripwire on melted records: no row at all, or a required value missing.

    A missing column is a programming error and is raised at once.
    """
    absent = [c for c in FORECAST_REQUIRED if c not in long.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    counted = long.agg(*[n.alias(check) for check, n in long_frame_counts(name).items()])
    pairs = [
        F.struct(F.lit(check).alias("check"), F.col(f"`{check}`").alias("n_violations")) for check in counted.columns
    ]
    return counted.select(F.inline(F.array(*pairs)))


def holiday_payload_checks(feed: DataFrame, key: str = "england-and-wales") -> DataFrame:
    """Tripwire on the holiday feed's main division."""
    body = F.col(f"`{key}`")
    as_payload = feed.select(body["division"].alias("division"), body["events"].alias("data"))
    division = row_counts(as_payload, {"holidays missing division": F.col("division").isNull()})
    return division.unionByName(payload_checks(as_payload.drop("division"), HOLIDAY_REQUIRED, "holidays"))


def enforce(results: DataFrame) -> DataFrame:
    """Raise if any check found a violation, else hand the results back."""
    failed = results.where(F.col("n_violations") > 0).collect()
    if failed:
        raise ValueError("; ".join(f"{row['check']}: {row['n_violations']}" for row in failed))
    return results
