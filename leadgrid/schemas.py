"""Declared schemas. Nothing is inferred, so an upstream rename shows up as
nulls that the tripwires in ``operators.checks`` count.

JSON keys are matched case-sensitively, so the file's own spelling is kept
here and renamed in staging.
"""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STRING, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
NTZ, DATE, BOOL = T.TimestampNTZType(), T.DateType(), T.BooleanType()

# Key spellings of the landed files and columns of the mart.
DEMAND_RECORD = _struct(
    ("publishTime", STRING),
    ("startTime", STRING),
    ("settlementDate", STRING),
    ("settlementPeriod", INT),
    ("initialDemandOutturn", LONG),
    ("initialTransmissionSystemDemandOutturn", LONG),
)

FORECAST_RECORD = _struct(
    ("target_ts", STRING),
    ("variable", STRING),
    ("value", DOUBLE),
    ("N", INT),
    ("issue_ts", STRING),
)

HOLIDAY_EVENT = _struct(
    ("title", STRING), ("date", STRING), ("notes", STRING), ("bunting", BOOL)
)
HOLIDAY_DIVISION = _struct(("division", STRING), ("events", T.ArrayType(HOLIDAY_EVENT)))
HOLIDAY_FEED = _struct(
    ("england-and-wales", HOLIDAY_DIVISION),
    ("scotland", HOLIDAY_DIVISION),
    ("northern-ireland", HOLIDAY_DIVISION),
)

MART = _struct(
    ("target_ts", NTZ),
    ("hour", INT),
    ("day", INT),
    ("lead_days", INT),
    ("demand_mw", DOUBLE),
    ("demand_lag_mw", DOUBLE),
    ("lag_7d", DOUBLE),
    ("lag_14d", DOUBLE),
    ("is_holiday", BOOL),
    ("temperature_2m", DOUBLE),
    ("heating_degrees", DOUBLE),
    ("cooling_degrees", DOUBLE),
    ("cutoff", NTZ),
    ("issue_ts", NTZ),
    ("demand_lag_ts", NTZ),
)


def with_series(record: T.StructType, series: tuple[str, ...]) -> T.StructType:
    """The record with its series key columns in front."""
    return T.StructType([T.StructField(c, STRING) for c in series] + record.fields)


def envelope(record: T.StructType, partition: str | None = None) -> T.StructType:
    """``{"data": [record, ...]}``, plus the directory's partition column."""
    fields = [T.StructField("data", T.ArrayType(record))]
    if partition:
        fields.append(T.StructField(partition, DATE))
    return T.StructType(fields)
