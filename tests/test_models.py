import datetime as dt
import glob
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fixtures import CFG, forecast_frame, holiday_frame, hourly_frame, hours
from leadgrid.config import PitConfig
from leadgrid.operators import scoring, tiling
from leadgrid.plans import tracking, walk_forward as wf
from leadgrid.plans.mart import build_mart, serving_rows

QUICK = wf.TreeParams(trees=15, step=0.3, depth=5, bins=64)
START, DAYS = "2024-01-01", 130


def weather(t):
    """A temperature with a three-week cycle, which weekly anchors miss."""
    day = t.timetuple().tm_yday
    return 10.0 + 8.0 * math.sin(day / 21 * 2 * math.pi) + 3.0 * math.sin(t.hour / 24 * 2 * math.pi)


def load(t):
    return 1000.0 + 20.0 * t.hour - 15.0 * weather(t)


@pytest.fixture(scope="module")
def inputs(spark):
    times = hours(START, 24 * DAYS, 1)
    forecast = forecast_frame(spark, times, temperature=lambda t, n: weather(t))
    return forecast, hourly_frame(spark, times, load), holiday_frame(spark)


@pytest.fixture(scope="module")
def frame(spark, inputs):
    return wf.training_frame(build_mart(*inputs, CFG), CFG)


@pytest.fixture(scope="module")
def folds(spark):
    span = spark.createDataFrame([(dt.date(2024, 3, 1), dt.date(2024, 5, 9))], "start_date date, end_date date")
    return tiling.collect_folds(tiling.folds(span, 7))


@pytest.fixture(scope="module")
def predictions(frame, folds):
    return wf.walk_forward(frame, folds, CFG, params=QUICK, parallelism=2)


def test_provenance_is_never_a_feature():
    assert not {"cutoff", "issue_ts", "demand_lag_ts", "target_ts", "demand_mw"} & set(wf.FEATURES)
    assert set(wf.FEATURES) - set(wf.NON_WEATHER_FEATURES) == set(wf.WEATHER_FEATURES)


def test_every_test_row_is_predicted_once(frame, folds, predictions):
    held_out = wf.between(frame, folds[0].test_start, folds[-1].test_end)
    keys = ["target_ts", "lead_days"]
    assert len(folds) == 2
    assert predictions.count() == held_out.count()
    assert predictions.select(*keys).exceptAll(held_out.select(*keys)).count() == 0
    assert predictions.columns == list(wf.PREDICTION_COLUMNS)
    assert predictions.where("demand_prediction is null").count() == 0


def test_missing_anchors_lose_no_row(frame, predictions):
    """At lead 7 the weekly anchor is always missing."""
    assert frame.where("lead_days = 7 and x_lag_7d_missing = 0").count() == 0
    assert predictions.where("lead_days = 7").count() > 0


def test_model_beats_the_baseline_on_a_weather_driven_load(predictions):
    rows = scoring.with_legal_anchor(predictions)
    assert scoring.improvement(rows).where("improvement_pct > -20").count() == 0


def test_removing_weather_costs_accuracy(frame, folds):
    got = wf.ablation(frame, folds[:1], CFG, QUICK)
    assert got.count() == 8 and got.where("lead_days >= 1 and pct_diff <= 0").count() == 0


def test_seed_sweep_has_a_row_per_seed_and_lead(frame, folds):
    params = wf.TreeParams(trees=3, step=0.3, depth=3, bins=32, row_share=0.8, feature_share="0.8")
    got = wf.seed_sweep(frame, folds[:1], CFG, seeds=(1, 2), params=params)
    assert got.groupBy("seed").count().collect() and got.count() == 16


def test_folds_without_training_data_are_refused(frame):
    early = tiling.Fold(dt.date(2023, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 2, 8))
    with pytest.raises(ValueError, match="empty or overlapping"):
        wf.walk_forward(frame, [early], CFG, params=QUICK)


def test_default_parameters():
    assert (wf.PARAMS.trees, wf.PARAMS.step, wf.PARAMS.min_rows, wf.PARAMS.row_share) == (500, 0.05, 20, 1.0)
    assert (wf.BAGGED.row_share, wf.BAGGED.feature_share) == (0.8, "0.8")


def test_batch_forecast_is_stored_by_run(spark, inputs, frame, tmp_path):
    forecast, hourly, holidays = inputs
    model = wf.fit(wf.between(frame, None, dt.date(2024, 4, 1)), wf.FEATURES, QUICK)
    model.save(f"{tmp_path}/model")
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(f"{tmp_path}/model")
    path = f"{tmp_path}/forecasts"
    for run in (dt.date(2024, 4, 2), dt.date(2024, 4, 3), dt.date(2024, 4, 2)):
        known = hourly.where(F.col("target_hour") < F.lit(run))
        rows = serving_rows(forecast, known, holidays, CFG)
        tracking.store_forecasts(tracking.batch_forecast(model, rows, run, CFG), path)
    stored = spark.read.parquet(path)
    runs = {r["issue_date"]: r["count"] for r in stored.groupBy("issue_date").count().collect()}
    assert set(runs) == {dt.date(2024, 4, 2), dt.date(2024, 4, 3)} and len(set(runs.values())) == 1
    tracked = tracking.with_actuals(stored, hourly, CFG)
    assert tracked.where("demand_mw is null").count() == 0
    assert tracked.count() == stored.count()


def test_rolling_statistics_stop_at_the_cutoff(spark):
    times = [t for i, t in enumerate(hours("2024-01-01", 24 * 12)) if i % 7]
    known = {t: float(i * i % 101) for i, t in enumerate(times)}
    rows = build_mart(forecast_frame(spark, times), hourly_frame(spark, times, known.get), holiday_frame(spark), CFG)
    got = tracking.rolling_known_past(rows, hourly_frame(spark, times, known.get), CFG, 24).collect()
    for r in got:
        past = [v for t, v in known.items() if r["cutoff"] - dt.timedelta(hours=23) <= t <= r["cutoff"]]
        assert r["mean_24h"] == pytest.approx(sum(past) / len(past))
        assert (r["min_24h"], r["max_24h"]) == (min(past), max(past))


def test_accuracy_over_time(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), 0, 100.0, 100.0 + i) for i in range(10) if i != 4]
    rows.append((start + dt.timedelta(days=10), 0, None, 1.0))
    tracked = spark.createDataFrame(rows, "target_ts timestamp_ntz, lead_days int, demand_mw double, p double")
    got = {r["target_date"].day: (r["n"], r["rmse"]) for r in tracking.accuracy_over_time(tracked, "p", 3).collect()}
    assert got[6] == (2, pytest.approx(math.sqrt((9 + 25) / 2)))
    assert 11 not in got


def test_promotion(spark):
    schema = "target_ts timestamp_ntz, lead_days int, demand_mw double, demand_prediction double"
    recent, old = dt.datetime(2024, 2, 1), dt.datetime(2023, 1, 1)
    champion = spark.createDataFrame([(recent, 0, 10.0, 12.0), (recent, 1, 10.0, 11.0), (old, 0, 10.0, 10.0)], schema)
    challenger = spark.createDataFrame([(recent, 0, 10.0, 11.0), (recent, 1, 10.0, 11.0), (old, 0, 10.0, 99.0)], schema)
    got = {r["lead_days"]: r["promote"] for r in tracking.promotion(champion, challenger, dt.date(2024, 1, 1), CFG).collect()}
    assert got == {0: True, 1: False}


def test_late_and_corrected_actuals_change_their_months_only(spark, tmp_path):
    times = hours("2024-01-01", 24 * 90, 24)
    pick = random.Random(3)
    actual = {t: float(pick.randint(900, 1100)) for t in times}
    forecasts = spark.createDataFrame([(t, n, 1000.0 + n) for t in times for n in range(3)], "target_ts timestamp_ntz, lead_days int, p double")
    path, late = str(tmp_path / "errors"), [t for t in times if t.day % 5 == 0]

    def arrive(known, new):
        tracking.update_accuracy(path, forecasts, hourly_frame(spark, known, actual.get), hourly_frame(spark, new, actual.get), CFG, "p")

    def whole():
        tracked = tracking.with_actuals(forecasts, hourly_frame(spark, times, actual.get), CFG)
        return sorted(tuple(r) for r in tracking.accuracy_over_time(tracked, "p", 28).collect())

    on_time = [t for t in times if t not in late]
    arrive(on_time, on_time)
    assert sorted(tuple(r) for r in tracking.stored_accuracy(spark, path, 28).collect()) != whole()
    arrive(times, late)
    assert sorted(tuple(r) for r in tracking.stored_accuracy(spark, path, 28).collect()) == whole()
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{path}/target_month=*/*.parquet")}
    corrected = times[40]
    actual[corrected] += 50.0
    arrive(times, [corrected])
    arrive(times, [corrected])  # again: nothing is counted twice
    assert sorted(tuple(r) for r in tracking.stored_accuracy(spark, path, 28).collect()) == whole()
    after = set(glob.glob(f"{path}/target_month=*/*.parquet"))
    assert {p.split("target_month=")[1][:10] for p in set(before) - after} == {"2024-02-01"}


def test_a_stored_model_predicts_the_same(spark, tmp_path, frame, folds):
    path, day = str(tmp_path / "models"), dt.date(2024, 4, 1)
    small = wf.TreeParams(trees=3, step=0.3, depth=3, bins=32)
    model = wf.fit(tracking.published(frame, day, CFG), wf.FEATURES, small)
    tracking.save_model(model, path, "a", day, CFG, small)
    tracking.save_model(wf.fit(wf.between(frame, None, dt.date(2024, 3, 1)), wf.FEATURES, small), path, "b", dt.date(2024, 3, 1), CFG, small)
    held = wf.between(frame, folds[0].test_start, folds[0].test_end)
    for run_date, version in ((day, "a"), (dt.date(2024, 3, 15), "b"), (dt.date(2030, 1, 1), "a")):
        got, loaded = tracking.load_model(spark, path, run_date, CFG)
        assert got == version
        if version == "a":
            assert wf.predicted(loaded, held, CFG).exceptAll(wf.predicted(model, held, CFG)).count() == 0
    facts = {r["version"]: r["trained_to"] for r in tracking.stored_models(spark, path).collect()}
    assert facts == {"a": day, "b": dt.date(2024, 3, 1)}
    with pytest.raises(ValueError, match="no model"):
        tracking.load_model(spark, path, dt.date(2024, 1, 1), CFG)
    with pytest.raises(ValueError, match="other rules"):
        tracking.load_model(spark, path, day, PitConfig(publication_lag_hours=9))


def test_noise_floor_is_the_spread_over_seeds(spark):
    pick = random.Random(1)
    rows = [(lead, seed, pick.random(), pick.random() - 2, pick.random() - 0.5) for lead in range(3) for seed in range(5)]
    sweep = spark.createDataFrame(rows, "lead_days int, seed int, rmse_pct_full double, rmse_pct_ablated double, pct_diff double")
    got = {(r["lead_days"], r["measure"]): r for r in wf.noise_floor(sweep).collect()}
    assert len(got) == 9
    for (lead, measure), r in got.items():
        at = {"rmse_pct_full": 2, "rmse_pct_ablated": 3, "pct_diff": 4}[measure]
        values = [row[at] for row in rows if row[0] == lead]
        assert r["n_seeds"] == 5 and math.isclose(r["sd"], statistics.stdev(values)) and math.isclose(r["mean"], statistics.mean(values))
        assert math.isclose(r["spread"], max(values) - min(values))
        assert r["one_sign"] == (len({math.copysign(1, v) for v in values}) == 1)


def test_variants_in_one_pool_are_those_alone(frame, folds, predictions):
    small = wf.TreeParams(trees=2, step=0.3, depth=2, bins=32)
    variants = [wf.Variant("x", wf.FEATURES, small), wf.Variant("y", wf.NON_WEATHER_FEATURES, small)]
    both = wf.walk_forwards(frame, folds, CFG, variants, parallelism=4)
    for v in variants:
        alone = wf.walk_forward(frame, folds, CFG, v.features, small)
        assert both.where(F.col("run") == v.run).drop("run").exceptAll(alone).count() == 0
    assert both.count() == 2 * predictions.count()
