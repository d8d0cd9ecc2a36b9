"""Baseline, error tables by lead and by slice, and comparisons of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.measures import mae, mape, rmse, temperature_band

ACTUAL = "demand_mw"
BASELINE = "baseline_prediction"
MODEL = "demand_prediction"


def with_baseline(mart: DataFrame, cfg: PitConfig) -> DataFrame:
    """Seasonal naive: the newest legal same-weekday anchor."""
    return mart.withColumn(BASELINE, F.coalesce(*cfg.anchor_columns))


def with_legal_anchor(rows: DataFrame) -> DataFrame:
    """Drop rows that have no anchor to be compared with."""
    return rows.dropna(subset=[BASELINE])


def holdout(mart: DataFrame, start, cfg: PitConfig) -> DataFrame:
    """The columns the baseline needs, from ``start`` on; both the columns and
    the bound reach the scan."""
    keep = [*cfg.grain, "demand_mw", *cfg.anchor_columns]
    return mart.where(F.col("target_ts") >= F.lit(start).cast("timestamp_ntz")).select(*keep)


def _measures(prediction: str, suffix: str = "") -> list[Column]:
    actual, predicted = F.col(ACTUAL), F.col(prediction)
    error = rmse(actual, predicted)
    mean = F.avg(actual)
    named = {"n": F.count("*"), "rmse": error, "mean_demand": mean, "rmse_pct": error / mean * 100}
    return [measure.alias(name + suffix) for name, measure in named.items()]


def _signed_error(prediction: str) -> Column:
    return F.avg(F.col(ACTUAL) - F.col(prediction)).alias("signed_error_mean")


def score_by_lead(rows: DataFrame, prediction: str = BASELINE) -> DataFrame:
    return rows.groupBy("lead_days").agg(*_measures(prediction))


def error_by_slice(rows: DataFrame, key: str, prediction: str = MODEL) -> DataFrame:
    """Errors per value of ``key``; rows without a value are in no slice."""
    known = rows.where(F.col(key).isNotNull())
    return known.groupBy(key).agg(*_measures(prediction), _signed_error(prediction))


def with_slices(rows: DataFrame) -> DataFrame:
    """Month of the UTC target and temperature band, for slicing."""
    return rows.withColumns(
        {"month": F.month("target_ts"), "temp_band": temperature_band(F.col("temperature_2m"))}
    )


SLICES = ("is_holiday", "temp_band", "month", "hour", "day")


def slice_measures(rows: DataFrame, prediction: str = MODEL, keys=SLICES) -> DataFrame:
    """All slices at once: (slice, value, measures...) from one pass; rows that
    a slice has no value for are under a null value.

    Each row counts once per slice, combined map-side, so only one partial
    result per slice value and task is shuffled.
    """
    pairs = [
        F.struct(F.lit(key).alias("slice"), F.col(key).cast("string").alias("value")) for key in keys
    ]
    long = rows.select(ACTUAL, prediction, F.inline(F.array(*pairs)))
    return long.groupBy("slice", "value").agg(*_measures(prediction), _signed_error(prediction))


def error_by_slices(rows: DataFrame, prediction: str = MODEL, keys=SLICES) -> DataFrame:
    """``slice_measures`` of the values there are."""
    return slice_measures(rows, prediction, keys).where(F.col("value").isNotNull())


def slice_totals(measured: DataFrame) -> DataFrame:
    """Rows that each slice of ``slice_measures`` covers next to all its rows."""
    known = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    return measured.groupBy("slice").agg(known.alias("n_sliced"), F.sum("n").alias("n_rows"))


def compare_scores(
    left: DataFrame, right: DataFrame, suffixes: tuple[str, str], on: str = "lead_days"
) -> DataFrame:
    """Two score tables side by side, measures told apart by suffix."""

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == on else c + suffix) for c in df.columns])

    return renamed(left, suffixes[0]).join(renamed(right, suffixes[1]), on, "left")


def ablation_difference(full: DataFrame, ablated: DataFrame) -> DataFrame:
    """Percentage points lost by removing features, per lead."""
    both = compare_scores(full, ablated, ("_full", "_ablated"))
    return both.withColumn("pct_diff", F.col("rmse_pct_ablated") - F.col("rmse_pct_full"))


def improvement(rows: DataFrame, model: str = MODEL, baseline: str = BASELINE) -> DataFrame:
    """Relative change of RMSE % against the baseline, per lead.

    Both are scored in one aggregate, so the rows are the same by construction
    and evaluated once.
    """
    both = rows.groupBy("lead_days").agg(*_measures(baseline, "_base"), *_measures(model, "_model"))
    change = (F.col("rmse_pct_model") - F.col("rmse_pct_base")) / F.col("rmse_pct_base")
    return both.withColumn("improvement_pct", change * 100)


def absolute_errors_by_lead(rows: DataFrame, prediction: str = BASELINE) -> DataFrame:
    actual, predicted = F.col(ACTUAL), F.col(prediction)
    return rows.groupBy("lead_days").agg(
        F.count("*").alias("n"),
        mae(actual, predicted).alias("mae"),
        mape(actual, predicted).alias("mape_pct"),
    )
