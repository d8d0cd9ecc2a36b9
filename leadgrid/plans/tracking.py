"""Stored forecasts: making them, tracking their accuracy, choosing a model."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.temporal import ntz, trunc_hour
from leadgrid.operators.lookups import over_hours
from leadgrid.functions.measures import rmse
from leadgrid.operators.scoring import ACTUAL, MODEL
from leadgrid.plans.walk_forward import TreeParams, between, encoded_frame, predicted


def rolling_known_past(rows: DataFrame, hourly: DataFrame, cfg: PitConfig, hours: int) -> DataFrame:
    """Add mean, least and greatest demand of the ``hours`` up to the cutoff.

    Statistics are rolled once over the hourly series and read at the cutoff's
    hour, so nothing later than the cutoff can enter them.
    """
    value = F.col("avg_initial_demand_outturn")
    names = {f"mean_{hours}h": F.avg(value), f"min_{hours}h": F.min(value), f"max_{hours}h": F.max(value)}
    rolled = over_hours(hourly, cfg.series, {n: (agg, hours - 1, 0) for n, agg in names.items()})
    side = rolled.select(*cfg.series, F.col("target_hour").alias("_key"), *names)
    keyed = rows.withColumn("_key", trunc_hour(F.col("cutoff")))
    return keyed.join(side, [*cfg.series, "_key"], "left").drop("_key")


def batch_forecast(
    model: PipelineModel, rows: DataFrame, run_date: dt.date, cfg: PitConfig
) -> DataFrame:
    """Predictions for the targets forecast on ``run_date``, stamped with it."""
    issued = rows.where(F.col("issue_ts") == ntz(run_date))
    scored = predicted(model, encoded_frame(issued, cfg), cfg)
    return scored.withColumn("issue_date", F.lit(run_date))


def published(rows: DataFrame, run_date: dt.date, cfg: PitConfig) -> DataFrame:
    """Rows whose label was published when ``run_date`` began."""
    last = dt.datetime.combine(run_date, dt.time()) - dt.timedelta(hours=cfg.publication_lag_hours)
    return between(rows, None, last)


def store_forecasts(forecasts: DataFrame, path: str) -> None:
    """Replace the run's own partition and leave other runs alone."""
    (
        forecasts.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("issue_date")
        .parquet(path)
    )


def with_actuals(forecasts: DataFrame, hourly: DataFrame, cfg: PitConfig) -> DataFrame:
    """Forecasts with the demand since observed, null while it is not."""
    actual = hourly.select(
        *cfg.series,
        F.col("target_hour").alias("target_ts"),
        F.col("avg_initial_demand_outturn").alias(ACTUAL),
    )
    return forecasts.drop(ACTUAL).join(actual, [*cfg.series, "target_ts"], "left")


def daily_errors(tracked: DataFrame, prediction: str) -> DataFrame:
    """(lead_days, target_date, n, sse): a day's known errors, which can be added up."""
    error = F.col(ACTUAL) - F.col(prediction)
    return (
        tracked.where(error.isNotNull())
        .groupBy("lead_days", F.col("target_ts").cast("date").alias("target_date"))
        .agg(F.count("*").alias("n"), F.sum(error * error).alias("sse"))
    )


def rolling_errors(daily: DataFrame, days: int) -> DataFrame:
    """RMSE per lead over the ``days`` up to each target day, from at most one
    row per lead and calendar day."""
    w = (
        Window.partitionBy("lead_days")
        .orderBy(F.unix_date("target_date"))
        .rangeBetween(-(days - 1), 0)
    )
    n, sse = F.sum("n").over(w), F.sum("sse").over(w)
    return daily.select("lead_days", "target_date", n.alias("n"), F.sqrt(sse / n).alias("rmse"))


def accuracy_over_time(tracked: DataFrame, prediction: str, days: int) -> DataFrame:
    """RMSE per lead over the ``days`` up to each target day.

    Errors are summed per lead and day first; the window then runs over at
    most one row per calendar day.
    """
    return rolling_errors(daily_errors(tracked, prediction), days)


def update_accuracy(
    path: str, forecasts: DataFrame, hourly: DataFrame, arrived: DataFrame, cfg: PitConfig, prediction: str
) -> None:
    """Bring the stored daily errors up to date with actuals that ``arrived``:
    new ones, late ones and corrected ones alike.

    The months that hold an arrived ``target_hour`` are counted again from the
    stored forecasts and all actuals by now, and replace their partitions; other
    months are neither read nor written. Running it again changes nothing.
    """
    month = F.trunc(F.col("target_hour").cast("date"), "month")
    months = [r[0] for r in arrived.select(month).distinct().collect()]  # a few dates
    if not months:
        return
    lo, hi = min(months), max(months) + dt.timedelta(days=31)
    at = F.col("target_ts")
    # the bounds reach the scan, the list drops the months between
    touched = forecasts.where((at >= ntz(lo)) & (at < ntz(hi)) & F.trunc(at.cast("date"), "month").isin(months))
    daily = daily_errors(with_actuals(touched, hourly, cfg), prediction)
    daily = daily.withColumn("target_month", F.trunc("target_date", "month"))
    (
        daily.coalesce(max(1, len(months) // 64))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("target_month")
        .parquet(path)
    )


def stored_accuracy(spark: SparkSession, path: str, days: int) -> DataFrame:
    """The rolling error, from the stored daily errors alone."""
    return rolling_errors(spark.read.parquet(path).drop("target_month"), days)


def save_model(
    model: PipelineModel, path: str, version: str, run_date: dt.date, cfg: PitConfig, params: TreeParams
) -> None:
    """The fitted pipeline with what it was made from: rules, parameters, and
    the run date before which its labels were published."""
    model.write().overwrite().save(f"{path}/{version}/pipeline")
    spark = SparkSession.active()
    facts = {"config": asdict(cfg), "params": asdict(params)}
    row = (version, run_date, json.dumps(facts, sort_keys=True, default=list))
    frame = spark.createDataFrame([row], "version string, trained_to date, facts string")
    frame.coalesce(1).write.mode("overwrite").json(f"{path}/{version}/facts")


def stored_models(spark: SparkSession, path: str) -> DataFrame:
    """(version, trained_to, facts) of every model under the path."""
    return spark.read.schema("version string, trained_to date, facts string").json(f"{path}/*/facts")


def load_model(spark: SparkSession, path: str, run_date: dt.date, cfg: PitConfig) -> tuple[str, PipelineModel]:
    """The newest model that was trained on nothing published after ``run_date``
    began, by its version. Its rules must be those of ``cfg``."""
    usable = stored_models(spark, path).where(F.col("trained_to") <= F.lit(run_date))
    newest = usable.orderBy(F.desc("trained_to"), F.desc("version")).first()
    if newest is None:
        raise ValueError(f"no model under {path} was trained by {run_date}")
    if json.loads(newest["facts"])["config"] != json.loads(json.dumps(asdict(cfg), default=list)):
        raise ValueError(f"model {newest['version']} was trained under other rules")
    return newest["version"], PipelineModel.load(f"{path}/{newest['version']}/pipeline")


def promotion(
    champion: DataFrame, challenger: DataFrame, since: dt.date, cfg: PitConfig, prediction: str = MODEL
) -> DataFrame:
    """Per lead, whether the challenger has the lower recent error.

    Both are scored on the rows that both have predicted. A lead without such
    rows is kept, without errors, and nothing is promoted there.
    """
    key = cfg.grain
    recent = [
        rows.where(F.col("target_ts") >= ntz(since)).select(*key, F.col(ACTUAL).alias(f"_{n}"), F.col(prediction).alias(n))
        for rows, n in ((champion, "champion"), (challenger, "challenger"))
    ]
    both = recent[0].join(recent[1], key, "full")
    shared = F.col("champion").isNotNull() & F.col("challenger").isNotNull()
    actual = F.coalesce("_champion", "_challenger")
    errors = {
        f"rmse_{n}": rmse(F.when(shared, actual), F.when(shared, F.col(n))) for n in ("champion", "challenger")
    }
    scored = both.groupBy("lead_days").agg(*[e.alias(n) for n, e in errors.items()])
    better = F.col("rmse_challenger") < F.col("rmse_champion")
    return scored.withColumn("promote", F.coalesce(better, F.lit(False)))


__all__ = [
    "accuracy_over_time", "batch_forecast", "daily_errors", "load_model", "promotion", "published",
    "rolling_errors", "rolling_known_past", "save_model", "store_forecasts", "stored_accuracy", "stored_models",
    "update_accuracy", "with_actuals",
]
