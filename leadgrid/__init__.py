"""Point-in-time feature marts and walk-forward evaluation on Spark.

A mart row is one ``(target_ts, lead_days)`` pair; every predictor in it was
knowable ``lead_days`` before the target. All operators take and return lazy
DataFrames.
"""

from leadgrid.config import PitConfig

__all__ = ["PitConfig"]
