import math
import random

import pytest
from pyspark.sql import functions as F

from leadgrid.functions.measures import mape, temperature_band
from leadgrid.operators import scoring


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    rows = [
        (n % 8, rng.uniform(100, 200), rng.uniform(100, 200), rng.choice([True, False]), rng.choice([None, -5.0, 3.0, 30.0]))
        for n in range(400)
    ]
    return spark.createDataFrame(
        rows, "lead_days int, demand_mw double, demand_prediction double, is_holiday boolean, temp double"
    ).withColumn("temp_band", temperature_band(F.col("temp"))).cache()


def by_hand(rows):
    errors = [r["demand_mw"] - r["demand_prediction"] for r in rows]
    rmse = math.sqrt(sum(e * e for e in errors) / len(errors))
    mean = sum(r["demand_mw"] for r in rows) / len(rows)
    return len(rows), rmse, mean, rmse / mean * 100, sum(errors) / len(errors)


def test_scores_by_lead(scored):
    rows = scored.collect()
    for got in scoring.score_by_lead(scored, scoring.MODEL).collect():
        want = by_hand([r for r in rows if r["lead_days"] == got["lead_days"]])
        assert tuple(got)[1:] == pytest.approx(want[:4])


def test_slices_leave_out_unknown_values(scored):
    rows = [r for r in scored.collect() if r["temp_band"] is not None]
    table = scoring.error_by_slice(scored, "temp_band").collect()
    assert sum(r["n"] for r in table) == len(rows) < scored.count()
    for got in table:
        want = by_hand([r for r in rows if r["temp_band"] == got["temp_band"]])
        assert tuple(got)[1:] == pytest.approx(want)


def test_all_slices_in_one_pass_equal_single_slices(scored):
    keys = ("is_holiday", "temp_band", "lead_days")
    together = scoring.error_by_slices(scored, keys=keys)
    for key in keys:
        one = {str(r[key]).lower(): r["rmse"] for r in scoring.error_by_slice(scored, key).collect()}
        many = {r["value"].lower(): r["rmse"] for r in together.where(F.col("slice") == key).collect()}
        assert many == pytest.approx(one)
    totals = {r["slice"]: (r["n_sliced"], r["n_rows"]) for r in scoring.slice_totals(scoring.slice_measures(scored, keys=keys)).collect()}
    assert totals["lead_days"] == totals["is_holiday"] == (400, 400)
    assert totals["temp_band"][0] < 400


BANDS = [(-1, "<0"), (0, "<0"), (0.1, "0-5"), (5, "0-5"), (10, "5-10"), (15, "10-15"), (20, "15-20"), (20.1, "20+")]


def test_bands_are_right_closed(spark):
    rows = spark.createDataFrame([(float(t),) for t, _ in BANDS] + [(None,)], "t double")
    got = [r[0] for r in rows.select(temperature_band(F.col("t"))).collect()]
    assert got == [b for _, b in BANDS] + [None]


def test_improvement_is_relative(scored):
    rows = scored.withColumn("baseline_prediction", F.col("demand_mw") + 10)
    rows = rows.withColumn("demand_prediction", F.col("demand_mw") + 5)
    got = scoring.improvement(rows).select("improvement_pct").distinct().collect()
    assert [r[0] for r in got] == pytest.approx([-50.0] * len(got))


def test_comparison_keeps_left_leads(scored):
    full = scoring.score_by_lead(scored, scoring.MODEL)
    got = scoring.ablation_difference(full, full.where("lead_days <> 3"))
    assert got.count() == 8
    assert got.where("lead_days = 3").first()["pct_diff"] is None
    assert got.where("lead_days <> 3 and pct_diff <> 0").count() == 0


def test_percentage_error_leaves_out_zero_actuals(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, p double")
    assert rows.select(mape(F.col("a"), F.col("p"))).first()[0] == 50.0
