import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import CFG, H, at, forecast_frame, holiday_frame, hourly_frame, hours
from leadgrid import schemas
from leadgrid.config import PitConfig
from leadgrid.operators import features, scoring
from leadgrid.plans.mart import build_mart, build_mart_by_joins, serving_rows

DAYS = 30


@pytest.fixture(scope="module")
def dense(spark):
    times = hours("2024-01-01", 24 * DAYS)
    args = forecast_frame(spark, times), hourly_frame(spark, times), holiday_frame(spark)
    return build_mart(*args, CFG).cache()


def head_loss(cfg=CFG):
    return sum(24 * n + cfg.publication_lag_hours for n in range(8))


def test_schema(dense):
    assert [(f.name, f.dataType) for f in dense.schema] == [(f.name, f.dataType) for f in schemas.MART]


def test_row_count_invariant(dense):
    assert dense.count() == 192 * DAYS - head_loss()


def test_rows_lost_per_lead(dense):
    counts = {r["lead_days"]: r["n"] for r in dense.groupBy("lead_days").agg(F.count("*").alias("n")).collect()}
    assert counts == {n: 24 * DAYS - (24 * n + 2) for n in range(8)}


def test_gates_by_lead(dense):
    filled = {
        r["lead_days"]: (r["a"], r["b"])
        for r in dense.groupBy("lead_days").agg(F.count("lag_7d").alias("a"), F.count("lag_14d").alias("b")).collect()
    }
    assert filled == {n: (24 * (DAYS - 7) if n < 7 else 0, 24 * (DAYS - 14)) for n in range(8)}


def test_values_come_from_their_hours(dense):
    value = lambda t: float(t.timestamp() // 3600 % 1000 + 1)
    for r in dense.where("lead_days = 3").collect():
        assert r["demand_mw"] == value(r["target_ts"])
        assert r["demand_lag_ts"] == r["cutoff"] == r["target_ts"] - 74 * H
        assert r["demand_lag_mw"] == value(r["demand_lag_ts"])


def test_baseline_falls_back_at_the_last_lead(dense):
    rows = scoring.with_baseline(dense, CFG)
    assert rows.where("lead_days = 7 and not baseline_prediction <=> lag_14d").count() == 0
    assert rows.where("lead_days < 7 and lag_7d is not null and baseline_prediction <> lag_7d").count() == 0


def gappy(spark):
    times = hours("2024-01-01", 24 * DAYS)
    missing = at("2024-01-10 05:00:00")
    present = [t for t in times if t != missing]
    args = forecast_frame(spark, times), hourly_frame(spark, present), holiday_frame(spark)
    return missing, args


def test_a_missing_hour_removes_only_what_reads_it(spark, dense):
    missing, args = gappy(spark)
    mart = build_mart(*args, CFG)
    key = ["target_ts", "lead_days"]
    lost = {(r[0], r[1]) for r in dense.select(*key).exceptAll(mart.select(*key)).collect()}
    label = {(missing, n) for n in range(8) if (missing - at("2024-01-01")) >= (24 * n + 2) * H}
    lagged = {(missing + (24 * n + 2) * H, n) for n in range(8)}
    assert lost == label | lagged
    anchored = mart.where(F.col("target_ts") == missing + 168 * H)
    assert anchored.where("lag_7d is not null").count() == 0
    neighbours = mart.where(F.col("target_ts").isin(missing + 167 * H, missing + 169 * H))
    assert neighbours.where("lead_days < 7 and lag_7d is null").count() == 0
    columns = [c for c in mart.columns if c not in CFG.anchor_columns]
    kept = dense.join(mart.select(*key), key, "left_semi").select(*columns)
    assert kept.exceptAll(mart.select(*columns)).count() == 0


def test_joins_give_the_same_mart(spark):
    _, args = gappy(spark)
    one, other = build_mart(*args, CFG), build_mart_by_joins(*args, CFG)
    assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_demand_span_an_hour_earlier(spark):
    times = hours("2024-01-01", 24 * DAYS)
    earlier = [t - H for t in times]
    mart = build_mart(forecast_frame(spark, times), hourly_frame(spark, earlier), holiday_frame(spark), CFG)
    counts = {r["lead_days"]: r["count"] for r in mart.groupBy("lead_days").count().collect()}
    # one unlabelled tail row, head loss one less
    assert counts == {n: 24 * DAYS - 1 - (24 * n + 1) for n in range(8)}


def test_lags_stay_real_hours_across_a_clock_change(spark):
    times = hours("2024-03-20", 24 * 20)
    mart = build_mart(forecast_frame(spark, times), hourly_frame(spark, times), holiday_frame(spark), CFG)
    row = mart.where((F.col("target_ts") == at("2024-04-01 10:00:00")) & (F.col("lead_days") == 2)).first()
    assert row["hour"] == 11
    assert row["demand_lag_ts"] == at("2024-03-30 08:00:00")
    hours_of_change = mart.where("lead_days = 0 and to_date(target_ts) = '2024-03-31'").orderBy("target_ts")
    assert [r["hour"] for r in hours_of_change.collect()] == [0, *range(2, 24), 0]


def test_holiday_flag_follows_the_local_date_and_division(spark):
    times = [at("2024-07-01 22:30:00"), at("2024-07-01 23:30:00"), at("2024-07-03 12:00:00")]
    rows = spark.createDataFrame([(t,) for t in times], "target_ts timestamp_ntz")
    days = holiday_frame(spark, [("2024-07-02", "eng&wales"), ("2024-07-03", "scotland")])
    got = {r["target_ts"]: r["is_holiday"] for r in features.attach_calendar(rows, days, CFG).collect()}
    assert got == dict(zip(times, [False, True, False]))


def test_hinges(spark):
    rows = spark.createDataFrame([(15.5,), (10.0,), (20.0,), (None,)], "temperature_2m double")
    got = features.add_degree_hinges(rows, CFG).collect()
    assert [tuple(r)[1:] for r in got] == [(0.0, 0.0), (5.5, 0.0), (0.0, 4.5), (None, None)]


def test_weather_shared_by_all_series(spark):
    cfg = PitConfig(series=("s",))
    times = hours("2024-01-01", 24 * 10)
    hourly = hourly_frame(spark, times).withColumn("s", F.explode(F.array(F.lit("x"), F.lit("y"))))
    mart = build_mart(forecast_frame(spark, times), hourly, holiday_frame(spark), cfg)
    single = build_mart(forecast_frame(spark, times), hourly_frame(spark, times), holiday_frame(spark), CFG)
    assert mart.where("s = 'y'").drop("s").exceptAll(single).count() == 0
    assert mart.count() == 2 * single.count()


def test_serving_rows_need_no_label(spark):
    past = hours("2024-01-01", 24 * 20)
    run_date = dt.datetime(2024, 1, 21)
    future = [run_date + i * H for i in range(24 * 8)]
    rows = serving_rows(forecast_frame(spark, future), hourly_frame(spark, past), holiday_frame(spark), CFG)
    issued = rows.where(F.col("issue_ts") == run_date)
    assert issued.where("lead_days = 1 and demand_mw is null").count() == 24 - 22
    assert issued.where(F.col("demand_lag_ts") > F.col("cutoff")).count() == 0


def test_longer_publication_lag_drops_the_weekly_anchor_earlier(spark):
    cfg = PitConfig(publication_lag_hours=30)
    times = hours("2024-01-01", 24 * DAYS)
    mart = build_mart(forecast_frame(spark, times), hourly_frame(spark, times), holiday_frame(spark), cfg)
    assert mart.where("lead_days >= 6 and lag_7d is not null").count() == 0
    assert mart.where("lead_days = 5 and lag_7d is not null").count() > 0
    assert mart.count() == 192 * DAYS - head_loss(cfg)


def test_leads_past_the_limit(spark):
    times = hours("2024-01-01", 24 * 20)
    args = forecast_frame(spark, times, range(-1, 10)), hourly_frame(spark, times), holiday_frame(spark)
    mart, joined = build_mart(*args, CFG), build_mart_by_joins(*args, CFG)
    assert {r[0] for r in mart.select("lead_days").distinct().collect()} == set(range(-1, 10))
    assert mart.exceptAll(joined).count() == joined.exceptAll(mart).count() == 0


def test_a_holiday_listed_twice_counts_once(spark):
    times = hours("2024-01-01", 24 * 10)
    days = [("2024-01-05", "eng&wales")]
    one, two = (build_mart(forecast_frame(spark, times), hourly_frame(spark, times), holiday_frame(spark, d), CFG) for d in (days, days * 2))
    assert one.count() == two.count() and one.exceptAll(two).count() == 0


def test_shared_weather_by_joins(spark):
    cfg = PitConfig(series=("s",))
    times = hours("2024-01-01", 24 * 10)
    hourly = hourly_frame(spark, times).withColumn("s", F.explode(F.array(F.lit("x"), F.lit("y"))))
    args = forecast_frame(spark, times), hourly, holiday_frame(spark), cfg
    one, other = build_mart(*args), build_mart_by_joins(*args)
    assert one.count() > 0 and one.exceptAll(other).count() == other.exceptAll(one).count() == 0
