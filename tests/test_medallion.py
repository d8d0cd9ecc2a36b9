import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadgrid.catalog import queries, standins
from leadgrid.catalog.standins import DAILY
from leadgrid.operators import checks, reshape, staging, tiling
from leadgrid.plans import medallion, walk_forward
from leadgrid.plans.mart import build_mart_by_joins, read_past
from leadgrid.sources import bronze
from leadgrid.sources.storage import as_table, as_view, load, scratch_path

SF_DIR = "/root/testdata/sf0.001"


def landed(spark, spoil=lambda envelopes: envelopes):
    inputs = queries.by_priority(spark, SF_DIR)
    paths = medallion.BronzePaths(*(scratch_path(spark, f"test-{n}") for n in "dfh"))
    bronze.land(spoil(bronze.demand_envelopes(inputs.demand, DAILY)), paths.demand, bronze.DEMAND_KEY)
    bronze.land(bronze.forecast_envelopes(inputs.long), paths.forecast, bronze.FORECAST_KEY)
    bronze.land_reference(standins.holiday_feed(inputs.demand), paths.holidays)
    return paths


@pytest.fixture(scope="module")
def built(spark):
    medallion.build_silver(spark, landed(spark), DAILY)
    return medallion.build_gold(spark, DAILY, partition_by_month=True)


def test_the_stored_mart_equals_the_one_built_in_memory(spark, built):
    direct = queries.mart_daily(spark, SF_DIR)
    stored = load(spark, "demand_features").drop("target_month").select(*direct.columns)
    assert stored.count() == direct.count() > 0
    assert stored.exceptAll(direct).count() == 0


def test_nineteen_checks_run(spark, built):
    results = {r["check"]: r["n_violations"] for r in medallion.run_checks(spark, DAILY).collect()}
    assert len(results) == 19
    # a daily series has no consecutive hours; everything else holds
    assert {k for k, v in results.items() if v} == {"demand_hourly.target_hour sequential"}


def test_reports(spark, built):
    last = built.agg(F.max("target_ts").cast("date")).first()[0]
    start = queries.holdout_start(last, 1)
    baseline = medallion.baseline_report(spark, start, DAILY)
    assert 0 < baseline.count() <= 8
    span = spark.createDataFrame([(start, last + dt.timedelta(days=31))], "start_date date, end_date date")
    folds = tiling.collect_folds(tiling.folds(span, 7))[:1]
    params = walk_forward.TreeParams(trees=3, step=0.3, depth=3, bins=32, min_rows=5)
    report = medallion.model_report(spark, folds, DAILY, params)
    assert report["improvement"].count() > 0
    assert {r["slice"] for r in report["slices"].select("slice").distinct().collect()} == {
        "is_holiday", "temp_band", "month", "hour", "day"
    }


def test_unusable_payloads_stop_the_build(spark):
    empty = lambda e: e.withColumn("data", F.slice("data", 1, 0))
    with pytest.raises(ValueError, match="demand empty data"):
        medallion.build_silver(spark, landed(spark, empty), DAILY)


def test_paths_are_plain_values():
    assert dataclasses.asdict(medallion.BronzePaths("d", "f", "h")) == {"demand": "d", "forecast": "f", "holidays": "h"}


def test_stored_sides_of_the_mart_meet_without_a_shuffle(spark, built):
    """Buckets of the same keys: neither table is dealt out again."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        forecast, past, _ = medallion.lay_out(spark, DAILY)
        plan = forecast.join(past.table, past.keys)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 1 and plan.count("FileScan") == 2
        mart = read_past(forecast.join(past.table, past.keys), past, load(spark, "bank_holidays"), DAILY)
        plan = mart._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the distinct holidays
    finally:
        spark.conf.set(key, before)


def test_leads_that_reach_further_change_no_row(spark):
    inputs = queries.by_priority(spark, SF_DIR)
    far = dataclasses.replace(DAILY, max_lead=30)
    long = reshape.melt_previous_runs(standins.weather_wide(inputs.demand, far, 24), far, reshape.variable_names("temperature_2m", 30))
    as_view(staging.pivot_forecast(long, DAILY), "weather_forecast", "silver_far")
    as_view(inputs.hourly, "demand_hourly", "silver_far")
    as_view(inputs.holidays, "bank_holidays", "silver_far")
    mart = medallion.build_gold(spark, DAILY, silver="silver_far", gold="gold_far")
    joined = build_mart_by_joins(staging.pivot_forecast(long, DAILY), inputs.hourly, inputs.holidays, DAILY)
    assert mart.agg(F.max("lead_days")).first()[0] == 30
    assert mart.exceptAll(joined.select(*mart.columns)).count() == 0 and mart.count() == joined.count()


def test_a_fault_is_seen_while_writing_and_nothing_is_published(spark):
    """Negative and doubled demand, and a mart with copies, stop before the table is there."""
    negative = lambda e: e.withColumn(
        "data", F.transform("data", lambda r: r.withField("initialDemandOutturn", -r["initialDemandOutturn"]))
    )
    for spoil, message in ((negative, "demand positive"), (lambda e: e.unionByName(e), "demand.start_time unique")):
        with pytest.raises(ValueError, match=message):
            medallion.build_silver(spark, landed(spark, spoil), DAILY, "silver_faulty")
        assert not spark.catalog.tableExists("silver_faulty.demand_hourly")
    medallion.build_silver(spark, landed(spark), DAILY, "silver_faulty")
    forecast = load(spark, "weather_forecast", "silver_faulty")
    as_view(forecast.unionByName(forecast.where("lead_days = 2")), "weather_forecast", "silver_faulty")
    with pytest.raises(ValueError, match="weather_forecast grain unique"):
        medallion.build_gold(spark, DAILY, silver="silver_faulty", gold="gold_faulty")
    assert not spark.catalog.tableExists("gold_faulty.demand_features")


def test_observed_copies_are_counted_by_key(spark):
    rows = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,), (3,), (None,), (None,)], "k int")
    watch = checks.Watch(checks.mark_copies(rows, ["k"]), {"null": F.col("k").isNull(), "copies": F.col(checks.COPY)})
    assert watch.df.count() == 8
    assert dict(watch.counts()) == {"null": 2, "copies": 3}
    with pytest.raises(ValueError, match="null: 2; copies: 3"):
        checks.enforce_watched(watch)


def test_a_partitioned_table_that_was_judged_holds_its_rows(spark):
    values = [("2020-01-01", "a"), ("2020-01-01", "b/c=d %41"), ("2020-02-01", "it's \\ so"), (None, None)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values * 2)], "id int, m string, k string")
    rows = rows.withColumn("m", F.col("m").cast("date"))
    for _ in range(2):  # a rebuild takes the place of the table
        table = as_table(rows, "judged", "gold_judged", partition_by=["m", "k"], judge=lambda: None)
        assert sorted(table.select(*rows.columns).collect()) == sorted(rows.collect())
    assert load(spark, "judged", "gold_judged").where("m = date'2020-02-01'").count() == 2


def test_counts_of_a_plan_that_turns_out_empty_are_not_lost(spark):
    """All rows go before the last shuffle, so adaptive execution drops what was counted behind it."""
    rows = spark.range(100).withColumn("odd", F.pmod(F.xxhash64("id"), F.lit(2)) == 1)
    watch = checks.Watch(rows, {"id from 90": F.col("id") >= 90}, {"rows": F.count(F.lit(1))})
    none = watch.df.where(F.xxhash64("id") == 1).repartition(3, "odd").groupBy("odd").count()
    none.write.parquet(scratch_path(spark, "test-none"))
    assert dict(watch.counts()) == {"id from 90": 10, "rows": 100}
    with pytest.raises(ValueError, match="id from 90: 10"):
        checks.enforce_watched(watch)
