"""Bronze: nested JSON under date directories, read and written faithfully.

Writers emit one envelope per record, so no day is ever gathered into one row
however large it is; readers accept envelopes of any length.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadgrid import schemas
from leadgrid.config import PitConfig
from leadgrid.functions.temporal import format_iso, ntz, parse_iso, shift
from leadgrid.operators.reshape import LEAD_SUFFIX
from leadgrid.sources.storage import stored

DEMAND_KEY = "settlement_date"
FORECAST_KEY = "issue_date"
CORRUPT = "_corrupt"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _read_days(spark, path: str, schema: T.StructType, key: str, lo: dt.date | None, hi: dt.date | None) -> DataFrame:
    """A closed range of partitions. Between two bounds the directories are
    named one by one, so no other day is listed; a day that was not landed has
    no rows. With one bound, partitions are pruned after listing."""
    if lo is not None and hi is not None:
        if lo > hi:
            return spark.createDataFrame([], schema)
        one_of = _one_of(lo, hi)
        reader = spark.read.schema(schema).option("mode", "FAILFAST").option("basePath", path)
        if not _exists(spark, f"{path}/{key}={one_of}"):
            return spark.createDataFrame([], schema)
        return reader.json(f"{path}/{key}={one_of}")
    df = _read(spark, path, schema)
    if lo is not None:
        df = df.where(F.col(key) >= F.lit(lo))
    if hi is not None:
        df = df.where(F.col(key) <= F.lit(hi))
    return df


def _one_of(lo: dt.date, hi: dt.date) -> str:
    """A path pattern for the days of a closed range."""
    return "{" + ",".join((lo + dt.timedelta(days=i)).isoformat() for i in range((hi - lo).days + 1)) + "}"


def _exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern names anything in its file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_demand(spark, path: str, cfg: PitConfig, lo=None, hi=None) -> DataFrame:
    record = schemas.with_series(schemas.DEMAND_RECORD, cfg.series)
    return _read_days(spark, path, schemas.envelope(record, DEMAND_KEY), DEMAND_KEY, lo, hi)


def read_forecast(spark, path: str, cfg: PitConfig, lo=None, hi=None) -> DataFrame:
    record = schemas.with_series(schemas.FORECAST_RECORD, cfg.series)
    return _read_days(spark, path, schemas.envelope(record, FORECAST_KEY), FORECAST_KEY, lo, hi)


def read_holidays(spark, path: str) -> DataFrame:
    return _read(spark, path, schemas.HOLIDAY_FEED)


def malformed_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, n_malformed, n_read) of the files that hold lines which are no
    envelope; ``n_read`` is the records that their other lines hold.

    The readers fail on such a line without saying how many there are. This
    reads on, keeps the line's text in a column, and counts by file.
    """
    permissive = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.schema(permissive).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    read = F.coalesce(F.when(F.col(CORRUPT).isNull(), F.size("data")), F.lit(0))
    counted = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(CORRUPT).alias("n_malformed"), F.sum(read).alias("n_read")
    )
    return counted.where(F.col("n_malformed") > 0)


def demand_envelopes(demand: DataFrame, cfg: PitConfig) -> DataFrame:
    """Silver demand as landed: one envelope per record, keyed by settlement date."""
    record = F.struct(
        *cfg.series,
        format_iso(F.col("publish_time")).alias("publishTime"),
        format_iso(F.col("start_time")).alias("startTime"),
        F.col("settlement_date").cast("string").alias("settlementDate"),
        F.col("settlement_period").alias("settlementPeriod"),
        F.col("initial_demand_outturn").alias("initialDemandOutturn"),
        F.col("initial_transmission_system_demand_outturn").alias("initialTransmissionSystemDemandOutturn"),
    )
    return demand.select(F.array(record).alias("data"), DEMAND_KEY)


def forecast_envelopes(long: DataFrame) -> DataFrame:
    """Long records as landed: ISO text inside an envelope, keyed by issue date."""
    key = F.col("issue_ts").cast("date").alias(FORECAST_KEY)
    texts = {c: format_iso(F.col(c)) for c in ("target_ts", "issue_ts")}
    fields = [texts[c].alias(c) if c in texts else F.col(c) for c in long.columns]
    return long.select(F.array(F.struct(*fields)).alias("data"), key)


def land(envelopes: DataFrame, path: str, key: str) -> None:
    """Replace exactly the partitions present in ``envelopes``.

    Running it again with the same input leaves the same files' content. The
    rebalance splits a large day over several files and packs small ones.
    """
    (
        envelopes.hint("rebalance", F.col(key))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .json(path)
    )


def land_reference(feed: DataFrame, path: str) -> None:
    """Unpartitioned reference data: the whole table is replaced."""
    feed.write.mode("overwrite").json(path)


def writable(long: DataFrame, lo: Column | dt.date, hi: Column | dt.date, cfg: PitConfig) -> DataFrame:
    """Records of issue dates whose whole target span lies in ``[lo, hi]``.

    A fetch of targets ``[lo, hi]`` sees only part of the leads of any issue
    date outside ``[lo, hi - max_lead]``; landing those would replace a full
    partition by a truncated one.
    """
    first = lo.cast("timestamp_ntz") if isinstance(lo, Column) else ntz(lo)
    last = hi.cast("timestamp_ntz") if isinstance(hi, Column) else ntz(hi)
    return long.where(F.col("issue_ts").between(first, shift(last, days=-cfg.max_lead)))


def rows_per_issue(long: DataFrame, cfg: PitConfig) -> DataFrame:
    return long.groupBy(*cfg.series, "issue_ts").agg(F.count("*").alias("n"))


def by_issue(
    long: DataFrame, cfg: PitConfig, per_lead: int = 24, variables: int = 1, also: tuple[str, ...] = ()
) -> DataFrame:
    """The records with ``_n`` and ``_whole``: the distinct records of the
    series' issue date, and whether these are every lead and hour.

    Distinct (target, variable) pairs are counted, so copies do not make a
    truncated date look full. A group is one issue date of one series, so the
    records are shuffled once and in small groups. ``also`` names columns that
    tell fetches apart.
    """
    pairs = F.collect_set(F.struct("target_ts", "variable"))
    n = F.size(pairs.over(Window.partitionBy(*also, *cfg.series, "issue_ts")))
    expected = len(cfg.leads) * per_lead * variables
    return long.withColumn("_n", n).withColumn("_whole", F.col("_n") == expected)


def withheld_issues(judged: DataFrame, cfg: PitConfig, also: tuple[str, ...] = ()) -> DataFrame:
    """(series, issue_ts, n) of what ``by_issue`` holds to be incomplete."""
    n = F.first("_n").cast("bigint").alias("n")
    return judged.where(~F.col("_whole")).groupBy(*also, *cfg.series, "issue_ts").agg(n)


def merge_forecast(long: DataFrame, path: str, cfg: PitConfig, is_stored: bool = False) -> None:
    """Land records into the shared partition space.

    A record replaces landed ones of its own series, target, issue time and
    variable (at whatever lead it was read); all else in its partition stays.
    Only the partitions of the incoming issue dates are read and written. Where
    none of them exists yet, the records are landed as they are; only a merge is
    written elsewhere first. Say so if the records are stored already.
    """
    spark = long.sparkSession
    incoming = long if is_stored else stored(long, "incoming")
    day = F.col("issue_ts").cast("date")
    span = incoming.agg(F.min(day), F.max(day)).first()
    if span[0] is None:
        return
    if not _exists(spark, f"{path}/{FORECAST_KEY}={_one_of(*span)}"):
        land(forecast_envelopes(incoming), path, FORECAST_KEY)
        return
    envelopes = forecast_envelopes(incoming)
    days = F.broadcast(incoming.select(day.alias(FORECAST_KEY)).distinct())
    landed = read_forecast(spark, path, cfg, *span).join(days, FORECAST_KEY, "left_semi")
    old = landed.select(F.inline("data"), FORECAST_KEY)
    key = [*cfg.series, "_target", "_issue", "_base"]

    def keyed(rows: DataFrame, at) -> DataFrame:
        base = F.regexp_replace("variable", LEAD_SUFFIX, "").alias("_base")
        return rows.select("*", at("target_ts").alias("_target"), at("issue_ts").alias("_issue"), base)

    new_keys = keyed(incoming, F.col).select(*key).distinct()
    kept = keyed(old, lambda c: parse_iso(F.col(c))).join(new_keys, key, "left_anti")
    record = F.struct(*[c for c in old.columns if c != FORECAST_KEY])
    kept = kept.select(F.array(record).alias("data"), FORECAST_KEY)
    # written elsewhere first: a partition cannot be read while it is replaced
    land(stored(kept.unionByName(_as_landed(envelopes, kept)), "merged"), path, FORECAST_KEY)


def _as_landed(envelopes: DataFrame, like: DataFrame) -> DataFrame:
    """Envelopes whose records have the fields of ``like``, missing ones null."""
    want = like.schema["data"].dataType.elementType
    have = envelopes.schema["data"].dataType.elementType.names

    def field(record: Column, f: T.StructField) -> Column:
        return (record[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    data = F.transform("data", lambda r: F.struct(*[field(r, f) for f in want.fields]))
    return envelopes.select(data.alias("data"), FORECAST_KEY)


def land_complete_forecast(
    long: DataFrame, path: str, lo, hi, cfg: PitConfig, per_lead: int = 24, variables: int = 1
) -> DataFrame:
    """Land a fetch of ``[lo, hi]``: of each series the issue dates that are
    whole. Returns the (series, issue_ts, n) that were withheld."""
    judged = stored(by_issue(writable(long, lo, hi, cfg), cfg, per_lead, variables), "judged")
    merge_forecast(judged.where("_whole").drop("_n", "_whole"), path, cfg, is_stored=True)
    return withheld_issues(judged, cfg)
