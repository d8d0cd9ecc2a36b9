"""Shapes of physical plans with broadcasts off, as for tables past the limit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import forecast_frame, holiday_frame, hourly_frame, hours, long_frame
from leadgrid.config import PitConfig
from leadgrid.operators import checks, scoring, staging
from leadgrid.plans.mart import build_mart, build_mart_by_joins
from leadgrid.sources import bronze
from leadgrid.sources.storage import stored

CFG = PitConfig(series=("s",))


@pytest.fixture(scope="module")
def inputs(spark):
    times = hours("2024-01-01", 24 * 20)
    two = F.explode(F.array(F.lit("x"), F.lit("y")))
    hourly = stored(hourly_frame(spark, times).withColumn("s", two), "hourly")
    forecast = stored(forecast_frame(spark, times).withColumn("s", two), "forecast")
    return forecast, hourly, stored(holiday_frame(spark), "holidays")


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_mart_reads_and_shuffles_each_input_once(inputs, no_broadcast):
    plan = plan_of(build_mart(*inputs, CFG))
    # forecast and hourly by block; holidays are counted and broadcast
    assert plan.count("Exchange hashpartitioning") == 2 + 1  # the distinct holidays
    assert plan.count("FileScan") == 3 and "Union" not in plan
    assert plan.count("SortMergeJoin") == 1
    assert "BroadcastHashJoin [_local_date" in plan


def test_other_leads_take_no_other_way(spark, inputs, no_broadcast):
    forecast, hourly, holidays = inputs
    every = stored(forecast.withColumn("lead_days", F.col("lead_days") * 3 - 1), "leads")
    plan = plan_of(build_mart(every, hourly, holidays, CFG))
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("SortMergeJoin") == 1


def test_two_shuffles_from_the_melt_to_the_mart(spark, inputs, no_broadcast):
    """Records meet in the pivot, its rows in the block of their target."""
    _, hourly, holidays = inputs
    two = F.explode(F.array(F.lit("x"), F.lit("y")))
    long = stored(long_frame(spark, "2024-01-01", 20).withColumn("s", two), "long")
    plan = plan_of(build_mart(staging.pivot_forecast(long, CFG), hourly, holidays, CFG, leads=(0, 7)))
    assert plan.count("Exchange hashpartitioning") == 4
    assert plan.count("REPARTITION_BY_NUM") >= 1


def test_completeness_needs_one_shuffle(spark, no_broadcast):
    long = stored(long_frame(spark, "2024-01-01", 10).withColumn("s", F.lit("x")), "long")
    plan = plan_of(bronze.by_issue(long, CFG).where("_whole"))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_shared_weather_is_not_shuffled_to_its_hours(spark, inputs, no_broadcast):
    forecast, hourly, holidays = inputs
    shared = stored(forecast.where("s = 'x'").drop("s"), "shared")
    plan = plan_of(build_mart(shared, hourly, holidays, CFG))
    assert "BroadcastHashJoin [_hour" in plan and "SortMergeJoin" not in plan


def test_the_join_chain_shuffles_more(inputs, no_broadcast):
    chain = plan_of(build_mart_by_joins(*inputs, CFG))
    assert chain.count("Exchange") > plan_of(build_mart(*inputs, CFG)).count("Exchange")


def test_the_mart_reads_only_its_columns(inputs):
    plan = plan_of(build_mart(*inputs, CFG).select("s", "target_ts", "demand_mw"))
    assert "temperature_2m" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_holdout_bound_and_columns_reach_the_scan(inputs):
    mart = stored(build_mart(*inputs, CFG), "mart")
    plan = plan_of(scoring.holdout(mart, dt.date(2024, 1, 10), CFG))
    assert "GreaterThanOrEqual(target_ts" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "lag_7d" in schema and "temperature_2m" not in schema and "cutoff" not in schema


def test_all_mart_checks_evaluate_the_mart_once(inputs):
    mart = stored(build_mart(*inputs, CFG), "mart")
    plan = plan_of(checks.mart_checks(mart, CFG))
    assert plan.count("FileScan") == 1


def test_hourly_demand_combines_before_the_shuffle(inputs):
    _, hourly, _ = inputs
    demand = hourly.select(
        "s", F.col("target_hour").alias("start_time"), F.lit(1).alias("initial_demand_outturn")
    )
    plan = plan_of(staging.hourly_demand(demand, CFG))
    assert plan.index("functions=[avg") < plan.index("Exchange") < plan.index("partial_avg")
