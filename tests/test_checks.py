import pytest
from pyspark.sql import functions as F

from fixtures import CFG, H, at, forecast_frame, holiday_frame, hourly_frame, hours
from leadgrid.config import PitConfig
from leadgrid.operators import checks
from leadgrid.plans.mart import build_mart


def results(df):
    return {r["check"]: r["n_violations"] for r in df.collect()}


@pytest.fixture(scope="module")
def mart(spark):
    times = hours("2024-01-01", 24 * 20)
    temperature = lambda t, n: float(t.hour + n)
    return build_mart(
        forecast_frame(spark, times, temperature=temperature), hourly_frame(spark, times), holiday_frame(spark), CFG
    ).cache()


def test_a_sound_mart_passes(mart):
    got = results(checks.mart_checks(mart, CFG))
    assert len(got) == 9 and set(got.values()) == {0}
    checks.enforce(checks.mart_checks(mart, CFG))


def test_swapped_hinges_fail_only_the_sign_check(mart):
    swapped = mart.withColumns(
        {"heating_degrees": F.col("cooling_degrees"), "cooling_degrees": F.col("heating_degrees")}
    )
    failed = {k: v for k, v in results(checks.mart_checks(swapped, CFG)).items() if v}
    assert failed == {"demand_features hinge sign": mart.count()}


def test_a_lag_read_at_the_target_fails_only_the_guard(mart):
    leaky = mart.withColumns({"demand_lag_mw": F.col("demand_mw"), "demand_lag_ts": F.col("target_ts")})
    failed = {k: v for k, v in results(checks.mart_checks(leaky, CFG)).items() if v}
    assert failed == {"demand_features leakage": mart.count()}


@pytest.mark.parametrize(
    "column, value",
    [
        ("lag_7d", "1.0D"),  # at lead 7 the weekly anchor is not yet published
        ("issue_ts", "target_ts"),
        ("cutoff", "target_ts"),
    ],
)
def test_each_kind_of_leak_is_seen(mart, column, value):
    lead7 = mart.where("lead_days = 7")
    assert checks.leakage(lead7, CFG).count() == 0
    assert checks.leakage(lead7.withColumn(column, F.expr(value)), CFG).count() == lead7.count() > 0


def test_duplicates_and_enforce(mart):
    doubled = mart.unionByName(mart.where("lead_days = 0").limit(5))
    table = checks.mart_checks(doubled, CFG)
    assert results(table)["demand_features grain unique"] == 5
    with pytest.raises(ValueError, match="grain unique: 5"):
        checks.enforce(table)


def test_sequence(spark):
    cfg = PitConfig(series=("s",))
    x = hours("2024-01-01", 3000)
    y = [t for t in x if t not in (at("2024-01-05 03:00:00"), at("2024-01-05 04:00:00"))]
    frame = (
        hourly_frame(spark, x).withColumn("s", F.lit("x"))
        .unionByName(hourly_frame(spark, y).withColumn("s", F.lit("y")))
    )
    got = [(r["s"], r["target_hour"]) for r in checks.sequence_breaks(frame, cfg).collect()]
    assert got == [("y", at("2024-01-05 05:00:00"))]
    assert checks.sequence_breaks(hourly_frame(spark, [x[0]]), CFG).count() == 0


def test_a_gap_longer_than_a_block_is_one_break(spark):
    early, late = hours("2020-01-01", 5), hours("2023-06-01", 5)
    got = checks.sequence_breaks(hourly_frame(spark, early + late), CFG).collect()
    assert [r["target_hour"] for r in got] == [late[0]]


def test_ranges(spark):
    rows = spark.createDataFrame([(-30.0,), (50.0,), (-30.1,), (50.1,), (None,)], "temperature_2m double")
    assert checks.out_of_range(rows, "temperature_2m", -30, 50).count() == 2
    demand = spark.createDataFrame([(0,), (-1,), (1,)], "initial_demand_outturn bigint")
    assert checks.not_positive(demand).count() == 2


SCHEMA = "data array<struct<settlementDate:string,settlementPeriod:int,initialDemandOutturn:bigint>>"


def test_payload_tripwire(spark):
    good, bad = ("2024-01-01", 1, 5), ("2024-01-01", None, None)
    rows = spark.createDataFrame([([good],), ([good, bad],), ([],), (None,)], SCHEMA)
    got = results(checks.payload_checks(rows, checks.DEMAND_REQUIRED, "demand"))
    assert got == {
        "demand no payload": 0, "demand no data key": 1, "demand empty data": 1,
        "demand missing settlementDate": 0, "demand missing settlementPeriod": 1,
        "demand missing initialDemandOutturn": 1,
    }
    nothing = results(checks.payload_checks(rows.limit(0), checks.DEMAND_REQUIRED, "demand"))
    assert nothing["demand no payload"] == 1


def test_long_frame_tripwire(spark):
    schema = "target_ts timestamp_ntz, issue_ts timestamp_ntz, value double"
    empty = spark.createDataFrame([], schema)
    assert results(checks.long_frame_checks(empty))["forecast empty"] == 1
    one = spark.createDataFrame([(at("2024-01-01"), at("2024-01-01") - H, None)], schema)
    assert results(checks.long_frame_checks(one))["forecast missing value"] == 1
    with pytest.raises(ValueError, match="issue_ts"):
        checks.long_frame_checks(empty.drop("issue_ts"))
