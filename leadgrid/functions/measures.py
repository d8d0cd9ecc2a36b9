"""Scalar and aggregate measures used by the mart and the score tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Right-closed temperature bands, upper bound -> label.
TEMPERATURE_BANDS = [(0, "<0"), (5, "0-5"), (10, "5-10"), (15, "10-15"), (20, "15-20")]
TOP_BAND = "20+"


def hinge(amount: Column) -> Column:
    """``amount`` where positive, else 0; null stays null, since Spark's
    ``greatest`` skips nulls and would turn a missing reading into 0."""
    return F.when(amount.isNotNull(), F.greatest(amount, F.lit(0.0)))


def gated(value: Column, known_at: Column, cutoff: Column) -> Column:
    """``value`` if its own instant is no later than ``cutoff``, else null."""
    return F.when(known_at <= cutoff, value)


def temperature_band(t: Column) -> Column:
    upper, label = TEMPERATURE_BANDS[0]
    band = F.when(t <= upper, label)
    for upper, label in TEMPERATURE_BANDS[1:]:
        band = band.when(t <= upper, label)
    return band.when(t > upper, TOP_BAND)


def rmse(actual: Column, predicted: Column) -> Column:
    """Population root mean squared error."""
    error = actual - predicted
    return F.sqrt(F.avg(error * error))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute error as a share of the actual, in percent; rows with a
    zero actual have no defined share and are left out."""
    return F.avg(F.abs((actual - predicted) / F.nullif(actual, F.lit(0.0)))) * 100
