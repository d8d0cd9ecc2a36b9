import datetime as dt
import glob
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from fixtures import CFG, H, at, hours, long_frame
from leadgrid import schemas
from leadgrid.config import PitConfig, table_name
from leadgrid.operators import reshape, staging
from leadgrid.plans import ingest
from leadgrid.sources import bronze, storage


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def demand_row(start, value, period):
    return {
        "publishTime": "2024-07-01T00:40:00Z", "startTime": start, "settlementDate": start[:10],
        "settlementPeriod": period, "initialDemandOutturn": value,
        "initialTransmissionSystemDemandOutturn": value + 1000,
    }


def test_reads_a_whole_day_in_one_envelope(spark, tmp_path):
    rows = [demand_row("2024-07-01T00:00:00Z", 21000, 1), demand_row("2024-07-01T00:30:00Z", 22000, 2)]
    write(f"{tmp_path}/settlement_date=2024-07-01/demand.json", json.dumps({"data": rows}))
    staged = staging.stage_demand(bronze.read_demand(spark, str(tmp_path), CFG), CFG)
    assert [f.dataType for f in staged.schema][:3] == [schemas.NTZ, schemas.NTZ, schemas.DATE]
    hourly = staging.hourly_demand(staged, CFG).collect()
    assert [tuple(r) for r in hourly] == [(at("2024-07-01"), 21500.0)]


def test_truncated_file_fails(spark, tmp_path):
    write(f"{tmp_path}/settlement_date=2024-07-01/demand.json", '{"data":[{"startTime":"2024-0')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        bronze.read_demand(spark, str(tmp_path), CFG).collect()


def test_range_read_prunes_directories(spark, tmp_path):
    for day in ("2024-07-01", "2024-07-02", "2024-07-03"):
        row = demand_row(f"{day}T00:00:00Z", 1, 1)
        write(f"{tmp_path}/settlement_date={day}/demand.json", json.dumps({"data": [row]}))
    day = dt.date(2024, 7, 2)
    bounded = bronze.read_demand(spark, str(tmp_path), CFG, day).where(F.col("settlement_date") <= day)
    assert bounded.count() == 1
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(settlement_date" in plan


def test_lead_is_read_or_derived(spark, tmp_path):
    record = {"target_ts": "2024-07-02T05:00:00.000Z", "issue_ts": "2024-07-01T00:00:00.000Z", "value": 12.5}
    backfill = {"data": [record | {"variable": "temperature_2m_previous_day1", "N": 1}]}
    live = {"data": [record | {"variable": "temperature_2m", "target_ts": "2024-07-04T05:00:00.000Z"}]}
    write(f"{tmp_path}/issue_date=2024-07-01/a.json", json.dumps(backfill))
    write(f"{tmp_path}/issue_date=2024-07-01/b.json", json.dumps(live))
    staged = staging.stage_forecast(bronze.read_forecast(spark, str(tmp_path), CFG), CFG)
    got = sorted((r["target_ts"].day, r["lead_days"], r["temperature_2m"]) for r in staged.collect())
    assert got == [(2, 1, 12.5), (4, 3, 12.5)]


def test_holiday_feed_keys(spark, tmp_path):
    event = {"title": "t", "date": "2024-01-01", "notes": "", "bunting": True}
    feed = {k: {"division": k, "events": [event]} for k in schemas.HOLIDAY_FEED.names}
    write(f"{tmp_path}/feed.json", json.dumps(feed))
    got = staging.stage_holidays(bronze.read_holidays(spark, str(tmp_path))).collect()
    assert {r["division"] for r in got} == {"eng&wales", "scotland"} and len(got) == 2


def landed(spark, path):
    return staging.records(bronze.read_forecast(spark, path, CFG))


def test_landing_twice_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/f"
    long = long_frame(spark, "2024-07-01", 10)
    for _ in range(2):
        bronze.land_complete_forecast(long, path, dt.date(2024, 7, 1), dt.date(2024, 7, 10), CFG)
    rows = landed(spark, path)
    assert rows.count() == 3 * 192 and rows.distinct().count() == 3 * 192
    assert len(glob.glob(f"{path}/issue_date=*")) == 3


def test_a_chunk_never_truncates_what_its_neighbour_wrote(spark, tmp_path):
    """Chunks of targets share issue dates near their boundary. Landing all
    they hold, the later chunk replaces whole partitions by parts of them;
    landing only what a chunk can complete keeps every partition whole."""
    chunks = [("2024-07-01", 14), ("2024-07-08", 14)]
    naive, guarded = f"{tmp_path}/naive", f"{tmp_path}/guarded"
    for first, days in chunks:
        long = long_frame(spark, first, days)
        bronze.land(bronze.forecast_envelopes(long), naive, bronze.FORECAST_KEY)
        lo = dt.date.fromisoformat(first)
        bronze.land_complete_forecast(long, guarded, lo, lo + dt.timedelta(days=days - 1), CFG)
    sizes = {
        path: {r["issue_ts"]: r["n"] for r in landed(spark, path).groupBy("issue_ts").agg(F.count("*").alias("n")).collect()}
        for path in (naive, guarded)
    }
    assert min(sizes[naive].values()) < 192
    assert set(sizes[guarded].values()) == {192} and len(sizes[guarded]) == 14


def test_a_date_with_a_missing_hour_is_not_landed(spark, tmp_path):
    long = long_frame(spark, "2024-07-01", 10).where(
        ~((F.col("target_ts") == at("2024-07-02 03:00:00")) & (F.col("N") == 1))
    )
    # a copy of another record must not make up for it
    copied = long.unionByName(long.where(F.col("target_ts") == at("2024-07-01 03:00:00")))
    withheld = bronze.land_complete_forecast(copied, f"{tmp_path}/f", dt.date(2024, 7, 1), dt.date(2024, 7, 10), CFG)
    assert [tuple(r) for r in withheld.collect()] == [(at("2024-07-01"), 191)]
    days = {os.path.basename(p) for p in glob.glob(f"{tmp_path}/f/issue_date=*")}
    assert days == {"issue_date=2024-07-02", "issue_date=2024-07-03"}


def test_a_gap_in_one_series_withholds_that_series_alone(spark, tmp_path):
    cfg = PitConfig(series=("meter",))
    two = F.explode(F.array(F.lit("a"), F.lit("b")))
    long = long_frame(spark, "2024-07-01", 10).withColumn("meter", two)
    gap = (F.col("meter") == "a") & (F.col("target_ts") == at("2024-07-02 03:00:00")) & (F.col("N") == 1)
    withheld = bronze.land_complete_forecast(long.where(~gap), f"{tmp_path}/f", dt.date(2024, 7, 1), dt.date(2024, 7, 10), cfg)
    assert [tuple(r) for r in withheld.collect()] == [("a", at("2024-07-01"), 191)]
    rows = staging.records(bronze.read_forecast(spark, f"{tmp_path}/f", cfg))
    counts = {(r["meter"], r["issue_ts"][:10]): r["n"] for r in rows.groupBy("meter", "issue_ts").agg(F.count("*").alias("n")).collect()}
    assert counts == {(m, f"2024-07-0{d}"): 192 for m in "ab" for d in (1, 2, 3) if (m, d) != ("a", 1)}


def test_a_live_run_replaces_its_own_records_only(spark, tmp_path):
    path = f"{tmp_path}/f"
    long = long_frame(spark, "2024-07-01", 10)
    bronze.land_complete_forecast(long, path, dt.date(2024, 7, 1), dt.date(2024, 7, 10), CFG)
    wide = spark.createDataFrame([(t, 99.0) for t in hours("2024-07-02", 48)], "date timestamp_ntz, temperature_2m double")
    for _ in range(2):
        ingest.ingest_live(wide, path, dt.date(2024, 7, 2), CFG, ["temperature_2m"])
    rows = landed(spark, path)
    assert rows.count() == 3 * 192
    assert rows.where("value = 99.0").count() == 48
    assert rows.where("value = 99.0 and N is null").count() == 48
    staged = staging.stage_forecast(bronze.read_forecast(spark, path, CFG), CFG)
    assert staged.count() == 3 * 192 and staged.where("temperature_2m = 99.0").agg(F.max("lead_days")).first()[0] == 1


def test_windows_land_every_date_but_the_last(spark, tmp_path):
    wide = spark.createDataFrame(
        [(t, *[float(n) for n in range(8)]) for t in hours("2024-07-01", 24 * 40)],
        "date timestamp_ntz, " + ", ".join(f"{n} double" for n in reshape.variable_names("temperature_2m", 7)),
    )
    span = spark.createDataFrame([(dt.date(2024, 7, 1), dt.date(2024, 8, 9))], "start_date date, end_date date")
    withheld = ingest.ingest_windows(wide, f"{tmp_path}/f", span, 12, CFG, "temperature_2m")
    assert withheld.count() == 0
    assert len(glob.glob(f"{tmp_path}/f/issue_date=*")) == 33 and landed(spark, f"{tmp_path}/f").count() == 33 * 192


def test_an_empty_required_value_stops_a_landing(spark, tmp_path):
    wide = spark.createDataFrame([(t, None) for t in hours("2024-07-02", 2)], "date timestamp_ntz, temperature_2m double")
    with pytest.raises(ValueError, match="missing value: 2"):
        ingest.ingest_live(wide, f"{tmp_path}/f", dt.date(2024, 7, 2), CFG, ["temperature_2m"])
    assert not os.path.exists(f"{tmp_path}/f")


def test_a_bounded_read_touches_its_own_days_only(spark, tmp_path):
    for day in ("2024-07-01", "2024-07-03"):
        row = demand_row(f"{day}T00:00:00Z", 1, 1)
        write(f"{tmp_path}/settlement_date={day}/demand.json", json.dumps({"data": [row]}))
    write(f"{tmp_path}/settlement_date=2024-07-05/demand.json", '{"data":[{"startTime":"2024-0')
    read = lambda lo, hi: bronze.read_demand(spark, str(tmp_path), CFG, dt.date(2024, 7, lo), dt.date(2024, 7, hi))
    assert read(1, 4).count() == 2 and read(2, 2).count() == 0 and read(3, 3).first()["settlement_date"] == dt.date(2024, 7, 3)
    assert len(read(1, 4).inputFiles()) == 2
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        read(4, 5).collect()


def test_leads_from_names(spark):
    names = ["temperature_2m", "temperature_2m_previous_day7", "x_previous_day12"]
    rows = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r[0] for r in rows.select(reshape.lead_of(F.col("v"))).collect()] == [0, 7, 12]


def test_issue_time_is_midnight_before(spark):
    long = long_frame(spark, "2024-07-10", 1)
    row = long.where((F.col("N") == 3) & (F.col("target_ts") == at("2024-07-10 17:00:00"))).first()
    assert row["issue_ts"] == at("2024-07-07") and row["value"] == 3.0


def test_live_run_has_one_issue_time(spark):
    wide = spark.createDataFrame([(t, 1.0, 2.0) for t in hours("2024-07-01", 48)], "date timestamp_ntz, a double, b double")
    long = reshape.melt_live_run(wide, CFG, ["a", "b"], dt.date(2024, 7, 1))
    assert long.count() == 96 and long.select("issue_ts").distinct().collect()[0][0] == at("2024-07-01")


def test_time_axis_is_right_open(spark):
    start = 1_704_067_200
    response = spark.createDataFrame([(start, start + 3 * 3600, 3600, [1.0, 2.0, 3.0])], "start bigint, end bigint, step bigint, v array<double>")
    got = [tuple(r) for r in reshape.time_axis(response, {"v": "x"}, []).collect()]
    assert got == [(at("2024-01-01") + i * H, float(i + 1)) for i in range(3)]
    empty = response.withColumn("end", F.col("start"))
    assert reshape.time_axis(empty, {"v": "x"}, []).count() == 0


def session(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf.get("folder", default)),
        sparkContext=SimpleNamespace(master=master, applicationId="run"),
    )


def test_shared_folder_comes_from_the_session():
    cluster = session("yarn", folder="/shared/place/")
    assert storage.scratch_path(cluster, "x").startswith("/shared/place/leadgrid/run/x-")


def test_only_a_local_session_may_use_a_folder_of_its_own():
    assert os.path.isdir(storage.shared_dir(session("local[2]")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session("spark://host:7077"))


def test_tables_by_layer(spark):
    frame = spark.range(3)
    assert storage.as_table(frame, "demand_features").count() == 3
    assert spark.table("gold.demand_features").count() == 3
    assert storage.as_table(spark.range(2), "demand_features").count() == 2
    view = storage.as_view(spark.range(4), "demand", "silver_a")
    other = storage.as_view(spark.range(5), "demand", "silver_b")
    assert (view.count(), other.count(), storage.load(spark, "demand", "silver_a").count()) == (4, 5, 4)
    assert table_name("demand_hourly") == "silver.demand_hourly"
    assert table_name("demand_hourly", "scratch") == "scratch.demand_hourly"


def test_series_columns_lead_the_record():
    record = schemas.with_series(schemas.DEMAND_RECORD, PitConfig(series=("meter",)).series)
    assert record.names[0] == "meter"


def test_malformed_lines_are_located(spark, tmp_path):
    good = '{"data":[{"title":"x","date":"2024-01-01"},{"title":"y","date":"2024-01-02"}]}'
    for name, lines in {"a": [good, good[:30], good], "b": [good], "c": ["{", "not json", ""], "d": []}.items():
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    record = T.StructType([T.StructField("title", T.StringType()), T.StructField("date", T.StringType())])
    schema = T.StructType([T.StructField("data", T.ArrayType(record))])
    got = {os.path.basename(r["file"]): (r["n_malformed"], r["n_read"]) for r in bronze.malformed_files(spark, f"file://{tmp_path}", schema).collect()}
    assert got == {"a.json": (1, 4), "c.json": (2, 0)}


def test_windows_withhold_what_each_of_them_lacks(spark, tmp_path):
    """A gap in one window's fetch keeps back its issue dates, and only these; the fetch is read once."""
    wide = spark.createDataFrame(
        [(t, *[float(n) for n in range(8)]) for t in hours("2024-07-01", 24 * 40) if t != at("2024-07-20 05:00:00")],
        "date timestamp_ntz, " + ", ".join(f"{n} double" for n in reshape.variable_names("temperature_2m", 7)),
    )
    span = spark.createDataFrame([(dt.date(2024, 7, 1), dt.date(2024, 8, 9))], "start_date date, end_date date")
    withheld = ingest.ingest_windows(wide, f"{tmp_path}/f", span, 12, CFG, "temperature_2m").collect()
    lacking = {dt.date(2024, 7, 20) - dt.timedelta(days=n) for n in range(8)}
    assert {r["issue_ts"].date() for r in withheld} == lacking and {r["n"] for r in withheld} == {191}
    assert len({r["window_start"] for r in withheld}) > 1
    landed_dates = {p.split("=")[1] for p in glob.glob(f"{tmp_path}/f/issue_date=*")}
    assert landed_dates == {str(dt.date(2024, 7, 1) + dt.timedelta(days=i)) for i in range(33)} - {str(d) for d in lacking}


def test_a_window_without_records_stops_a_backfill(spark, tmp_path):
    wide = spark.createDataFrame(
        [(t, *[1.0] * 8) for t in hours("2024-07-01", 24 * 15)],
        "date timestamp_ntz, " + ", ".join(f"{n} double" for n in reshape.variable_names("temperature_2m", 7)),
    )
    span = spark.createDataFrame([(dt.date(2024, 7, 1), dt.date(2024, 8, 30))], "start_date date, end_date date")
    with pytest.raises(ValueError, match="windows without records: .'2024-07-16'"):
        ingest.ingest_windows(wide, f"{tmp_path}/f", span, 12, CFG, "temperature_2m")
    assert not os.path.exists(f"{tmp_path}/f")
