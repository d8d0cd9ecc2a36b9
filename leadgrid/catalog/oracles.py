"""ANSI SQL for the same results, over the same tables."""

from __future__ import annotations

_HALF_HOUR = "time_bucket(INTERVAL 30 MINUTE, ts)"
_SOURCES = {
    "event": ("events", "event_type", _HALF_HOUR, "value * 100", 1, 2),
    "user": ("events", "CAST(user_id AS VARCHAR)", _HALF_HOUR, "value * 100", 1, 2),
    "national": ("events", "'all'", _HALF_HOUR, "value * 100", 1, 2),
    "order": ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", 24, 24),
}

_MART_COLUMNS = (
    "series_id, target_ts, hour, day, lead_days, demand_mw, demand_lag_mw, lag_7d, lag_14d, "
    "is_holiday, temperature_2m, heating_degrees, cooling_degrees, cutoff, issue_ts, demand_lag_ts"
)


def _inputs(kind: str) -> str:
    source, series, start, amount, step, lag = _SOURCES[kind]
    return f"""
WITH demand AS (
  SELECT {series} AS series_id, {start} AS start_time,
         CAST(sum(CAST(round({amount}) AS BIGINT)) AS BIGINT) AS outturn, count(*) AS n
  FROM {source} GROUP BY 1, 2),
staged AS (
  SELECT series_id, start_time + INTERVAL 1 HOUR AS publish_time, start_time,
         CAST(start_time AS DATE) AS settlement_date,
         CAST(extract(hour FROM start_time) * 2 + extract(minute FROM start_time) // 30 + 1
              AS INTEGER) AS settlement_period,
         outturn AS initial_demand_outturn,
         CAST(outturn + n AS BIGINT) AS initial_transmission_system_demand_outturn
  FROM demand),
hourly AS (
  SELECT series_id, date_trunc('hour', start_time) AS target_hour, avg(outturn) AS mw
  FROM demand GROUP BY 1, 2),
span AS (
  SELECT series_id, min(target_hour) AS lo, max(target_hour) AS hi FROM hourly GROUP BY 1),
axis AS (
  SELECT series_id, unnest(generate_series(lo, hi, INTERVAL {step} HOUR)) AS target_ts FROM span),
leads AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS lead_days),
fc AS (
  SELECT series_id, target_ts, CAST(CAST(target_ts AS DATE) AS TIMESTAMP) - to_days(lead_days) AS issue_ts,
         lead_days,
         ((CAST(epoch(target_ts) AS BIGINT) // 3600 * 7 + lead_days * 13) % 400) / CAST(10 AS DOUBLE) - 10
           AS temperature_2m
  FROM axis CROSS JOIN leads),
holidays AS (
  SELECT DISTINCT CAST(start_time AS DATE) AS holiday_date,
         'Holiday on the ' || day(start_time) AS title, division
  FROM demand JOIN (VALUES ('eng&wales', 1), ('eng&wales', 15), ('scotland', 1), ('scotland', 2))
       AS h(division, d) ON day(start_time) = h.d),
cut AS (
  SELECT *, target_ts - to_days(lead_days) - INTERVAL {lag} HOUR AS cutoff FROM fc),
cal AS (
  SELECT c.*, CAST(extract(hour FROM loc) AS INTEGER) AS hour,
         CAST(extract(isodow FROM loc) AS INTEGER) AS day, h.holiday_date IS NOT NULL AS is_holiday
  FROM (SELECT *, (target_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS loc FROM cut) c
  LEFT JOIN holidays h ON CAST(loc AS DATE) = h.holiday_date AND h.division = 'eng&wales'),
joined AS (
  SELECT c.*, d.mw AS demand_mw, l.mw AS demand_lag_mw, l.target_hour AS demand_lag_ts,
         CASE WHEN target_ts - INTERVAL 168 HOUR <= cutoff THEN d7.mw END AS lag_7d,
         CASE WHEN target_ts - INTERVAL 336 HOUR <= cutoff THEN d14.mw END AS lag_14d,
         CASE WHEN temperature_2m IS NOT NULL THEN greatest(15.5 - temperature_2m, CAST(0 AS DOUBLE)) END
           AS heating_degrees,
         CASE WHEN temperature_2m IS NOT NULL THEN greatest(temperature_2m - 15.5, CAST(0 AS DOUBLE)) END
           AS cooling_degrees
  FROM cal c
  LEFT JOIN hourly d ON d.series_id = c.series_id AND d.target_hour = c.target_ts
  LEFT JOIN hourly l ON l.series_id = c.series_id AND l.target_hour = date_trunc('hour', c.cutoff)
  LEFT JOIN hourly d7 ON d7.series_id = c.series_id AND d7.target_hour = c.target_ts - INTERVAL 168 HOUR
  LEFT JOIN hourly d14 ON d14.series_id = c.series_id AND d14.target_hour = c.target_ts - INTERVAL 336 HOUR),
mart AS (
  SELECT {_MART_COLUMNS} FROM joined WHERE demand_mw IS NOT NULL AND demand_lag_mw IS NOT NULL),
based AS (SELECT *, coalesce(lag_7d, lag_14d) AS baseline_prediction FROM mart),
scored AS (
  SELECT *, CAST(month(target_ts) AS INTEGER) AS month,
         CASE WHEN temperature_2m <= 0 THEN '<0' WHEN temperature_2m <= 5 THEN '0-5'
              WHEN temperature_2m <= 10 THEN '5-10' WHEN temperature_2m <= 15 THEN '10-15'
              WHEN temperature_2m <= 20 THEN '15-20' WHEN temperature_2m > 20 THEN '20+' END AS temp_band
  FROM based WHERE baseline_prediction IS NOT NULL)
"""


def _measures(p: str, suffix: str = "") -> str:
    return f"""count(*) AS n{suffix},
  round(sqrt(avg((demand_mw - {p}) * (demand_mw - {p}))), 4) AS rmse{suffix},
  avg(demand_mw) AS mean_demand{suffix},
  round(sqrt(avg((demand_mw - {p}) * (demand_mw - {p}))) / avg(demand_mw) * 100, 4) AS rmse_pct{suffix}"""


_SIGNED = "avg(demand_mw - baseline_prediction) AS signed_error_mean"


def _slice(key: str) -> str:
    return (
        _inputs("order")
        + f"SELECT {key}, {_measures('baseline_prediction')}, {_SIGNED} FROM scored "
        f"WHERE {key} IS NOT NULL GROUP BY 1"
    )


_SLICED = """,
sliced AS (
  SELECT demand_mw, baseline_prediction, unnest(['is_holiday', 'temp_band', 'month', 'hour', 'day']) AS slice,
         unnest([CAST(is_holiday AS VARCHAR), temp_band, CAST(month AS VARCHAR), CAST(hour AS VARCHAR),
                 CAST(day AS VARCHAR)]) AS value
  FROM scored)
"""

_HOLDOUT = """
holdout AS (
  SELECT CAST(date_trunc('month', max(o_orderdate)) - to_months(12) AS DATE) AS start_date,
         CAST(max(o_orderdate) AS DATE) AS end_date FROM orders),
folds AS (
  SELECT CAST(s - INTERVAL 7 DAY AS DATE) AS train_end, CAST(s AS DATE) AS test_start,
         CAST(s + INTERVAL 1 MONTH AS DATE) AS test_end
  FROM (SELECT unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP),
                                      INTERVAL 1 MONTH)) AS s, end_date FROM holdout)
  WHERE s + INTERVAL 1 MONTH <= end_date)
"""

_FORECAST_COLUMNS = "series_id, target_ts, issue_ts, lead_days, temperature_2m"
_VARIABLE = "CASE WHEN lead_days = 0 THEN 'temperature_2m' ELSE 'temperature_2m_previous_day' || lead_days END"
_DEMAND_COLUMNS = (
    "series_id, publish_time, start_time, settlement_date, settlement_period, "
    "initial_demand_outturn, initial_transmission_system_demand_outturn"
)
_LIVE = (
    """,
live AS (
  SELECT series_id, target_ts, variable, temperature_2m AS value, CAST(first_day AS TIMESTAMP) AS issue_ts
  FROM fc JOIN (VALUES (0, 'temperature_2m'), (1, 'dew_point_2m')) AS v(l, variable) ON lead_days = l,
       (SELECT min(CAST(start_time AS DATE)) AS first_day FROM demand))
"""
)
_LIVE_PIVOT = """
SELECT series_id, target_ts, issue_ts,
       CAST(date_diff('day', CAST(issue_ts AS DATE), CAST(target_ts AS DATE)) AS INTEGER) AS lead_days,
       max(value) FILTER (WHERE variable = 'temperature_2m') AS temperature_2m{extra}
FROM live GROUP BY 1, 2, 3, 4
"""


def _checks(*pairs: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        f'SELECT \'{name}\' AS "check", CAST(({sql}) AS BIGINT) AS n_violations' for name, sql in pairs
    )


def _rows(relation: str, condition: str) -> str:
    return f"SELECT count(*) FROM {relation} WHERE {condition}"


def _copies(relation: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT 1 FROM {relation} GROUP BY {keys} HAVING count(*) > 1)"


_LEAKY = """demand_lag_ts > cutoff
  OR (target_ts - INTERVAL 168 HOUR > cutoff AND lag_7d IS NOT NULL)
  OR (target_ts - INTERVAL 336 HOUR > cutoff AND lag_14d IS NOT NULL)
  OR issue_ts > target_ts - to_days(lead_days) OR cutoff > target_ts - to_days(lead_days)"""
_WRONG_SIGN = """(heating_degrees > 0 AND temperature_2m > 15.5)
  OR (cooling_degrees > 0 AND temperature_2m < 15.5)"""
_BREAKS = """SELECT series_id, target_hour FROM (
  SELECT series_id, target_hour, lag(target_hour) OVER (PARTITION BY series_id ORDER BY target_hour) AS prev
  FROM hourly) WHERE target_hour <> prev + INTERVAL 1 HOUR"""

_DEMAND_CHECKS = [
    ("demand.start_time not null", _rows("demand", "start_time IS NULL")),
    ("demand.initial_demand_outturn not null", _rows("demand", "outturn IS NULL")),
    ("demand.start_time unique", _copies("demand", "series_id, start_time")),
    ("demand positive", _rows("demand", "outturn <= 0")),
]
_HOURLY_CHECKS = [
    ("demand_hourly.target_hour not null", _rows("hourly", "target_hour IS NULL")),
    ("demand_hourly.target_hour unique", _copies("hourly", "series_id, target_hour")),
    ("demand_hourly.target_hour sequential", f"SELECT count(*) FROM ({_BREAKS})"),
]
_FORECAST_CHECKS = [
    ("weather_forecast temperature range", _rows("fc", "temperature_2m < -30 OR temperature_2m > 50")),
    ("weather_forecast grain unique", _copies("fc", "series_id, target_ts, issue_ts")),
]
_HOLIDAY_CHECKS = [("bank_holidays grain unique", _copies("holidays", "holiday_date, division"))]
_NOT_NULL_MART = ["target_ts", "lead_days", "demand_mw", "demand_lag_mw", "is_holiday", "temperature_2m"]

_MART_CHECKS = [
    *[(f"demand_features.{c} not null", _rows("mart", f"{c} IS NULL")) for c in _NOT_NULL_MART],
    ("demand_features leakage", _rows("mart", _LEAKY)),
    ("demand_features hinge sign", _rows("mart", _WRONG_SIGN)),
    ("demand_features grain unique", _copies("mart", "series_id, target_ts, lead_days")),
]

def _on(bad: str, relation: str, checks: list[tuple[str, str]]) -> str:
    """Checks of a relation made on a spoilt one."""
    moved = [(name, sql.replace(f"FROM {relation} ", "FROM bad ")) for name, sql in checks]
    return f", bad AS ({bad})\n" + _checks(*moved)


_GAP = "AND NOT (series_id = 'error' AND lead_days = 3 AND hour(target_ts) = 10 AND day(target_ts) % 5 = 0)"
_PER_SERIES = """, per_series AS (
  SELECT issue_ts, series_id, count(*) AS n FROM fc
  WHERE issue_ts >= (SELECT min(CAST(start_time AS DATE)) FROM demand)
    AND issue_ts <= (SELECT max(CAST(start_time AS DATE)) - 7 FROM demand) {but} GROUP BY 1, 2)
"""

ORACLES: dict[str, str] = {
    "demand_halfhourly": _inputs("event") + f"SELECT {_DEMAND_COLUMNS} FROM staged",
    "demand_hourly": _inputs("event")
    + "SELECT series_id, target_hour, mw AS avg_initial_demand_outturn FROM hourly",
    "demand_hourly_by_user": _inputs("user")
    + "SELECT series_id, target_hour, mw AS avg_initial_demand_outturn FROM hourly",
    "forecast_wide": _inputs("event")
    + "SELECT series_id, target_ts AS date, max(temperature_2m) FILTER (WHERE lead_days = 0) AS temperature_2m, "
    + ", ".join(
        f"max(temperature_2m) FILTER (WHERE lead_days = {n}) AS temperature_2m_previous_day{n}"
        for n in range(1, 8)
    )
    + " FROM fc GROUP BY 1, 2",
    "forecast_unpivot": _inputs("event")
    + f'SELECT series_id, target_ts, {_VARIABLE} AS variable, temperature_2m AS value, lead_days AS "N", '
    "issue_ts FROM fc",
    "forecast_unpivot_variables": _inputs("event") + _LIVE + "SELECT * FROM live",
    "forecast_pivot": _inputs("event") + f"SELECT {_FORECAST_COLUMNS} FROM fc",
    "forecast_pivot_live": _inputs("event")
    + _LIVE
    + _LIVE_PIVOT.format(extra=", max(value) FILTER (WHERE variable = 'dew_point_2m') AS dew_point_2m"),
    "holidays_union": _inputs("order") + "SELECT * FROM holidays",
    "bronze_roundtrip_demand": _inputs("event") + f"SELECT {_DEMAND_COLUMNS} FROM staged",
    "bronze_range_read": _inputs("event")
    + f"SELECT {_DEMAND_COLUMNS} FROM staged "
    "WHERE settlement_date >= (SELECT CAST(max(ts) AS DATE) - 6 FROM events)",
    "bronze_roundtrip_forecast": _inputs("event") + f"SELECT {_FORECAST_COLUMNS} FROM fc",
    "bronze_roundtrip_live": _inputs("event") + _LIVE + _LIVE_PIVOT.format(extra=""),
    "bronze_roundtrip_holidays": _inputs("order") + "SELECT * FROM holidays",
    "layers_roundtrip": _inputs("event")
    + "SELECT series_id, target_hour, mw AS avg_initial_demand_outturn FROM hourly",
    "check_payload": _inputs("event")
    + _checks(
        ("demand no payload", "0"),
        ("demand no data key", _rows("demand", "day(start_time) = 2")),
        ("demand empty data", _rows("demand", "day(start_time) = 3")),
        ("demand missing settlementDate", "0"),
        ("demand missing settlementPeriod", _rows("demand", "series_id = 'error'")),
        ("demand missing initialDemandOutturn", _rows("demand", "outturn > 10000")),
        ("forecast empty", "0"),
        ("forecast missing target_ts", _rows("fc", "hour(target_ts) = 3 AND lead_days = 1")),
        ("forecast missing issue_ts", _rows("fc", "hour(target_ts) = 4 AND lead_days = 2")),
        ("forecast missing value", _rows("fc", "temperature_2m <= 0")),
        ("holidays missing division", "0"),
        ("holidays no payload", "0"),
        ("holidays no data key", "0"),
        (
            "holidays empty data",
            "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY year(o_orderdate) "
            "HAVING count(*) FILTER (WHERE day(o_orderdate) IN (1, 15)) = 0)",
        ),
        ("holidays missing title", "0"),
        ("holidays missing date", "0"),
    ),
    "window_tiles": """
WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
w AS (SELECT lo + CAST(k AS INTEGER) * 28 AS window_start, hi
      FROM span, LATERAL (SELECT unnest(range((hi - lo) // 28 + 1)) AS k))
SELECT window_start, least(window_start + 27, hi) AS window_end,
       (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN window_start AND window_start + 27) AS n
FROM w""",
    "window_tiles_overlap": """
WITH RECURSIVE span AS (
  SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
w AS (
  SELECT lo AS window_start, least(lo + 29, hi) AS window_end, hi FROM span WHERE lo + 7 <= hi
  UNION ALL
  SELECT window_end - 6, least(window_end + 23, hi), hi FROM w WHERE window_end + 1 <= hi)
SELECT window_start, window_end, window_end - 7 AS writable_end,
       (SELECT count(*) FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN window_start AND window_end - 7) AS n
FROM w""",
    "rows_per_issue": _inputs("event") + "SELECT series_id, issue_ts, count(*) AS n FROM fc GROUP BY 1, 2",
    "complete_partitions": _inputs("event")
    + _PER_SERIES.format(but=_GAP)
    + """SELECT CAST(issue_ts AS DATE) AS issue_date, CAST(sum(n) AS BIGINT) AS n
FROM per_series WHERE n = 192 GROUP BY 1""",
    "withheld_partitions": _inputs("event")
    + _PER_SERIES.format(but=_GAP)
    + "SELECT series_id, issue_ts, n FROM per_series WHERE n <> 192",
    "ingest_windows": _inputs("event")
    + _PER_SERIES.format(but="")
    + """SELECT CAST(issue_ts AS DATE) AS issue_date, CAST(sum(n) AS BIGINT) AS n
FROM per_series WHERE n = 192 GROUP BY 1""",
    "live_over_backfill": _inputs("event")
    + _PER_SERIES.format(but="")
    + """, landed AS (
  SELECT fc.* FROM fc JOIN per_series p USING (series_id, issue_ts) WHERE p.n = 192),
run AS (SELECT max(CAST(start_time AS DATE)) - 7 AS run FROM demand),
live AS (
  SELECT series_id, target_ts, CAST(run AS TIMESTAMP) AS issue_ts,
         CAST(date_diff('day', run, CAST(target_ts AS DATE)) AS INTEGER) AS lead_days,
         temperature_2m + 100 AS temperature_2m
  FROM fc, run WHERE lead_days = 0 AND CAST(target_ts AS DATE) BETWEEN run AND run + 2)
SELECT series_id, target_ts, issue_ts, lead_days, temperature_2m
FROM landed l WHERE NOT EXISTS (
  SELECT 1 FROM live v WHERE (v.series_id, v.target_ts, v.issue_ts) = (l.series_id, l.target_ts, l.issue_ts))
UNION ALL SELECT * FROM live""",
    "mart_label": _inputs("event") + f"SELECT {_FORECAST_COLUMNS}, demand_mw FROM joined",
    "mart_cutoff_lag": _inputs("event")
    + f"SELECT {_FORECAST_COLUMNS}, cutoff, demand_lag_mw, demand_lag_ts FROM joined",
    "mart_anchors": _inputs("event") + f"SELECT {_FORECAST_COLUMNS}, cutoff, lag_7d, lag_14d FROM joined",
    "mart_calendar": _inputs("order") + f"SELECT {_FORECAST_COLUMNS}, hour, day, is_holiday FROM joined",
    "mart_hinges": _inputs("event")
    + f"SELECT {_FORECAST_COLUMNS}, heating_degrees, cooling_degrees FROM joined",
    "bronze_to_gold": _inputs("event") + "SELECT * FROM mart",
    "mart_full": _inputs("event") + "SELECT * FROM mart",
    "mart_full_by_joins": _inputs("event") + "SELECT * FROM mart",
    "mart_national": _inputs("national") + "SELECT * EXCLUDE (series_id) FROM mart",
    "mart_by_user": _inputs("user") + "SELECT * FROM mart",
    "mart_daily": _inputs("order") + "SELECT * FROM mart",
    "mart_shared_weather": _inputs("event")
    .replace("span AS (\n  SELECT series_id, min(target_hour) AS lo, max(target_hour) AS hi FROM hourly GROUP BY 1)",
             "span AS (\n  SELECT s.series_id, min(h.target_hour) AS lo, max(h.target_hour) AS hi\n"
             "  FROM hourly h CROSS JOIN (SELECT DISTINCT series_id FROM hourly) s GROUP BY 1)")
    + "SELECT * FROM mart",
    "mart_all_leads": _inputs("event")
    .replace("unnest(range(8))", "unnest(range(-1, 16))")
    .replace("lead_days * 13", "greatest(lead_days, 0) * 13")
    + "SELECT * FROM mart",
    "mart_summary": _inputs("event")
    + """SELECT lead_days, count(*) AS n, sum(demand_lag_mw) AS sum_demand_lag_mw,
  round(sum(temperature_2m), 4) AS sum_temperature_2m, count(lag_7d) AS n_lag_7d, count(lag_14d) AS n_lag_14d
FROM mart GROUP BY 1""",
    "local_calendar_dst": """
SELECT CAST(loc AS DATE) AS local_date, CAST(extract(hour FROM loc) AS INTEGER) AS hour,
       CAST(extract(isodow FROM loc) AS INTEGER) AS day, count(*) AS n
FROM (SELECT ((o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))) AT TIME ZONE 'UTC')
             AT TIME ZONE 'Europe/London' AS loc FROM orders)
GROUP BY 1, 2, 3""",
    "rolling_known_past": _inputs("event")
    + f""", rolled AS (
  SELECT series_id, target_hour, round(avg(mw) OVER w, 4) AS mean_24h, min(mw) OVER w AS min_24h,
         max(mw) OVER w AS max_24h
  FROM hourly
  WINDOW w AS (PARTITION BY series_id ORDER BY target_hour RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW))
SELECT {", ".join("c." + x for x in _FORECAST_COLUMNS.split(", "))}, c.cutoff, mean_24h, min_24h, max_24h
FROM cut c LEFT JOIN rolled r ON r.series_id = c.series_id AND r.target_hour = date_trunc('hour', c.cutoff)""",
    "check_demand": _inputs("event") + _checks(*_DEMAND_CHECKS),
    "check_hourly": _inputs("event") + _checks(*_HOURLY_CHECKS),
    "check_range": _inputs("event")
    + "SELECT series_id, target_hour, mw AS avg_initial_demand_outturn FROM hourly WHERE mw < 1000 OR mw > 20000",
    "check_duplicates": "SELECT user_id, date_trunc('hour', ts) AS target_hour, count(*) AS n FROM events "
    "GROUP BY 1, 2 HAVING count(*) > 1",
    "check_sequence": _inputs("user") + _BREAKS,
    "check_forecast": _inputs("event") + _checks(*_FORECAST_CHECKS),
    "check_holidays": _inputs("order") + _checks(*_HOLIDAY_CHECKS),
    "check_mart": _inputs("event") + _checks(*_MART_CHECKS),
    "check_all_layers": _inputs("event")
    + _checks(*_DEMAND_CHECKS, *_HOURLY_CHECKS, *_FORECAST_CHECKS, *_HOLIDAY_CHECKS, *_MART_CHECKS),
    "check_observed": _inputs("event")
    + _checks(*_DEMAND_CHECKS, *_HOURLY_CHECKS, *_FORECAST_CHECKS, *_HOLIDAY_CHECKS, *_MART_CHECKS),
    "check_demand_faults": _inputs("event")
    + _on(
        """SELECT series_id, start_time, CASE WHEN hour(start_time) = 5 AND day(start_time) = 2 THEN NULL
  WHEN hour(start_time) = 3 THEN -outturn ELSE outturn END AS outturn FROM demand
UNION ALL SELECT series_id, start_time, outturn FROM demand WHERE day(start_time) = 3""",
        "demand",
        _DEMAND_CHECKS,
    ),
    "check_hourly_faults": _inputs("event")
    + """, bad AS (SELECT series_id, target_hour FROM hourly WHERE hour(target_hour) <> 7
  UNION ALL SELECT series_id, target_hour FROM hourly WHERE hour(target_hour) = 9
  UNION ALL SELECT series_id, NULL FROM hourly WHERE hour(target_hour) = 8),
"""
    + "known AS (SELECT DISTINCT series_id, target_hour FROM bad WHERE target_hour IS NOT NULL)\n"
    + _checks(
        ("demand_hourly.target_hour not null", _rows("bad", "target_hour IS NULL")),
        ("demand_hourly.target_hour unique", _copies("(SELECT * FROM bad WHERE target_hour IS NOT NULL)", "series_id, target_hour")),
        (
            "demand_hourly.target_hour sequential",
            """SELECT count(*) FROM bad b WHERE target_hour > (SELECT min(target_hour) FROM known k WHERE k.series_id = b.series_id)
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.series_id = b.series_id AND k.target_hour = b.target_hour - INTERVAL 1 HOUR)""",
        ),
    ),
    "check_forecast_faults": _inputs("event")
    + _on(
        """SELECT * REPLACE (temperature_2m + CASE WHEN lead_days = 3 AND hour(target_ts) = 10 THEN 100 ELSE 0 END AS temperature_2m) FROM fc
UNION ALL SELECT * FROM fc WHERE lead_days = 2""",
        "fc",
        _FORECAST_CHECKS,
    ),
    "check_holiday_faults": _inputs("order")
    + _on("SELECT * FROM holidays UNION ALL SELECT * FROM holidays WHERE division = 'scotland'", "holidays", _HOLIDAY_CHECKS),
    "check_mart_faults": _inputs("event")
    + _on(
        """SELECT * REPLACE (
  CASE WHEN NOT (lead_days = 0 AND hour(target_ts) = 4) THEN demand_mw END AS demand_mw,
  CASE WHEN NOT (lead_days = 5 AND hour(target_ts) = 6) THEN is_holiday END AS is_holiday,
  CASE WHEN NOT (lead_days = 2 AND hour(target_ts) = 4) THEN temperature_2m END AS temperature_2m,
  CASE WHEN lead_days = 3 THEN 1 ELSE heating_degrees END AS heating_degrees,
  CASE WHEN lead_days = 4 THEN target_ts ELSE demand_lag_ts END AS demand_lag_ts) FROM mart
UNION ALL SELECT * FROM mart WHERE lead_days = 1""",
        "mart",
        _MART_CHECKS,
    ),
    "forecast_pivot_copies": _inputs("event") + f"SELECT {_FORECAST_COLUMNS} FROM fc",
    "check_leakage_mutated": _inputs("event")
    + f""", leaky AS (
  SELECT * REPLACE (demand_mw AS demand_lag_mw, target_ts AS demand_lag_ts) FROM mart)
SELECT * FROM leaky WHERE {_LEAKY}""",
    "check_hinge_mutated": _inputs("event")
    + f""", swapped AS (
  SELECT * REPLACE (heating_degrees AS cooling_degrees, cooling_degrees AS heating_degrees) FROM mart)
SELECT * FROM swapped WHERE {_WRONG_SIGN}""",
    "check_shipped_before_ordered": """
SELECT l_orderkey, l_linenumber, l_shipdate AS target_ts, o_orderdate AS issue_ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate""",
    "folds": "WITH " + _HOLDOUT + "SELECT * FROM folds",
    "fold_membership": _inputs("order")
    + ", "
    + _HOLDOUT
    + """SELECT train_end, test_start, test_end,
  count(*) FILTER (WHERE target_ts < train_end) AS n_train,
  count(*) FILTER (WHERE target_ts >= test_start AND target_ts < test_end) AS n_test,
  max(target_ts) FILTER (WHERE target_ts < train_end) AS last_train,
  min(target_ts) FILTER (WHERE target_ts >= test_start AND target_ts < test_end) AS first_test
FROM folds CROSS JOIN mart GROUP BY 1, 2, 3""",
    "baseline_by_lead": _inputs("order")
    + f"SELECT lead_days, {_measures('baseline_prediction')} FROM scored GROUP BY 1",
    "holdout_baseline": _inputs("order")
    + ", "
    + _HOLDOUT
    + f"SELECT lead_days, {_measures('baseline_prediction')} FROM scored "
    "WHERE target_ts >= (SELECT start_date FROM holdout) GROUP BY 1",
    "error_by_holiday": _slice("is_holiday"),
    "error_by_band": _slice("temp_band"),
    "error_by_month": _slice("month"),
    "error_by_hour": _slice("hour"),
    "error_by_day": _slice("day"),
    "error_by_slices": _inputs("order")
    + _SLICED
    + f"SELECT slice, value, {_measures('baseline_prediction')}, {_SIGNED} FROM sliced "
    "WHERE value IS NOT NULL GROUP BY 1, 2",
    "slice_totals": _inputs("order")
    + _SLICED
    + "SELECT slice, count(value) AS n_sliced, (SELECT count(*) FROM scored) AS n_rows FROM sliced GROUP BY 1",
    "score_compare": _inputs("order")
    + f"""SELECT lead_days, {_measures('baseline_prediction', '_base')}, {_measures('demand_lag_mw', '_model')},
  round((sqrt(avg((demand_mw - demand_lag_mw) * (demand_mw - demand_lag_mw)))
     / sqrt(avg((demand_mw - baseline_prediction) * (demand_mw - baseline_prediction))) - 1) * 100, 4)
    AS improvement_pct FROM scored GROUP BY 1""",
    "ablation_compare": _inputs("order")
    + f"""SELECT lead_days, {_measures('demand_lag_mw', '_full')}, {_measures('baseline_prediction', '_ablated')},
  round((sqrt(avg((demand_mw - baseline_prediction) * (demand_mw - baseline_prediction)))
     - sqrt(avg((demand_mw - demand_lag_mw) * (demand_mw - demand_lag_mw)))) / avg(demand_mw) * 100, 4)
    AS pct_diff FROM scored GROUP BY 1""",
    "mae_mape": _inputs("order")
    + """SELECT lead_days, count(*) AS n, round(avg(abs(demand_mw - baseline_prediction)), 4) AS mae,
  round(avg(abs((demand_mw - baseline_prediction) / nullif(demand_mw, 0))) * 100, 4) AS mape_pct
FROM scored GROUP BY 1""",
    "accuracy_tracker": _inputs("order")
    + """, daily AS (
  SELECT lead_days, CAST(target_ts AS DATE) AS target_date, count(*) AS c,
         sum((demand_mw - baseline_prediction) * (demand_mw - baseline_prediction)) AS sse
  FROM scored GROUP BY 1, 2)
SELECT lead_days, target_date, CAST(sum(c) OVER w AS BIGINT) AS n,
       round(sqrt(sum(sse) OVER w / sum(c) OVER w), 4) AS rmse
FROM daily
WINDOW w AS (PARTITION BY lead_days ORDER BY target_date
             RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)""",
    "promotion": _inputs("order")
    + """, recent AS (
  SELECT * FROM scored WHERE target_ts >= (
    SELECT date_trunc('month', max(o_orderdate)) - to_months(3) FROM orders)),
errors AS (
  SELECT lead_days, sqrt(avg((demand_mw - baseline_prediction) * (demand_mw - baseline_prediction))) AS a,
         sqrt(avg((demand_mw - demand_lag_mw) * (demand_mw - demand_lag_mw))) AS b
  FROM recent WHERE lead_days < 6 GROUP BY 1
  UNION ALL SELECT DISTINCT lead_days, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM recent WHERE lead_days >= 6)
SELECT lead_days, round(a, 4) AS rmse_champion, round(b, 4) AS rmse_challenger, coalesce(b < a, false) AS promote FROM errors""",
    "fold_checks": _inputs("order")
    + ", "
    + _HOLDOUT
    + """, listed AS (
  SELECT train_end, test_start, test_end FROM folds
  UNION ALL SELECT start_date, start_date, start_date + 28 FROM holdout
  UNION ALL SELECT end_date - 7, end_date, end_date + 28 FROM holdout
  UNION ALL SELECT DATE '1900-01-01', DATE '1900-02-01', DATE '1900-03-01'),
counted AS (
  SELECT train_end, test_start, test_end, count(*) FILTER (WHERE target_ts < train_end) AS n_train,
         count(*) FILTER (WHERE target_ts >= test_start AND target_ts < test_end) AS n_test,
         max(target_ts) FILTER (WHERE target_ts < train_end) AS last_train,
         min(target_ts) FILTER (WHERE target_ts >= test_start AND target_ts < test_end) AS first_test
  FROM listed CROSS JOIN mart GROUP BY 1, 2, 3)
SELECT train_end, test_start, test_end, fault FROM (
  SELECT train_end, test_start, test_end, unnest([
    CASE WHEN train_end > test_start - 7 THEN 'purge' END,
    CASE WHEN test_end > (SELECT end_date FROM holdout) THEN 'end' END,
    CASE WHEN n_train = 0 THEN 'empty train' END, CASE WHEN n_test = 0 THEN 'empty test' END,
    CASE WHEN last_train >= first_test THEN 'overlap' END]) AS fault FROM counted)
WHERE fault IS NOT NULL""",
    "walk_forward_rows": _inputs("order")
    + ", "
    + _HOLDOUT
    + """SELECT series_id, target_ts, lead_days, demand_mw, baseline_prediction FROM based
WHERE EXISTS (SELECT 1 FROM folds WHERE target_ts >= test_start AND target_ts < test_end)""",
    "ablation_rows": _inputs("order")
    + ", "
    + _HOLDOUT
    + """SELECT lead_days, count(*) AS n_full, count(*) AS n_ablated, avg(demand_mw) AS mean_demand_full,
  avg(demand_mw) AS mean_demand_ablated FROM scored
WHERE EXISTS (SELECT 1 FROM folds WHERE target_ts >= test_start AND target_ts < test_end) GROUP BY 1""",
    "serving_features": _inputs("order")
    + f"""SELECT {_MART_COLUMNS} FROM joined WHERE demand_lag_mw IS NOT NULL
  AND issue_ts = (SELECT CAST(CAST(max(o_orderdate) AS DATE) - 7 AS TIMESTAMP) FROM orders)""",
}

ORACLES |= {
    "malformed_files": _inputs("event")
    + """SELECT settlement_date, count(*) FILTER (WHERE settlement_period % 3 = 0) AS n_malformed,
  count(*) FILTER (WHERE settlement_period % 3 <> 0) AS n_read
FROM staged WHERE day(settlement_date) = 2 GROUP BY 1 HAVING n_malformed > 0""",
    "fold_rows": _inputs("order")
    + ", "
    + _HOLDOUT
    + """, sides AS (
  SELECT test_start, 'train' AS side, TIMESTAMP '0001-01-01' AS lo, CAST(train_end AS TIMESTAMP) AS hi FROM folds
  UNION ALL SELECT test_start, 'test', CAST(test_start AS TIMESTAMP), CAST(test_end AS TIMESTAMP) FROM folds)
SELECT test_start, side, series_id, lead_days, count(*) AS n, min(target_ts) AS first_target, max(target_ts) AS last_target
FROM mart JOIN sides ON target_ts >= lo AND target_ts < hi GROUP BY 1, 2, 3, 4""",
    "accuracy_incremental": ORACLES["accuracy_tracker"],
    "batch_forecast_rows": _inputs("order")
    + """SELECT series_id, target_ts, lead_days, CAST(issue_ts AS DATE) AS issue_date FROM joined
WHERE demand_lag_mw IS NOT NULL
  AND issue_ts = (SELECT CAST(CAST(max(o_orderdate) AS DATE) - 7 AS TIMESTAMP) FROM orders)""",
    "sweep_rows": _inputs("order")
    + ", "
    + _HOLDOUT
    + """SELECT seed, lead_days, count(*) AS n_full, count(*) AS n_ablated, avg(demand_mw) AS mean_demand_full,
  avg(demand_mw) AS mean_demand_ablated FROM scored CROSS JOIN (SELECT unnest([42, 0, 1, 2, 3]) AS seed)
WHERE EXISTS (SELECT 1 FROM folds WHERE target_ts >= test_start AND target_ts < test_end) GROUP BY 1, 2""",
    "model_inputs": _inputs("order")
    + "SELECT series_id, target_ts, lead_days, CAST(hour AS DOUBLE) AS x_hour, CAST(day - 1 AS DOUBLE) AS x_day, "
    "CAST(lead_days AS DOUBLE) AS x_lead_days, CAST(is_holiday AS DOUBLE) AS x_is_holiday, demand_lag_mw AS x_demand_lag_mw, "
    + ", ".join(
        f"coalesce({c}, 0) AS x_{c}, CAST({c} IS NULL AS DOUBLE) AS x_{c}_missing"
        for c in ("temperature_2m", "heating_degrees", "cooling_degrees", "lag_7d", "lag_14d")
    )
    + " FROM mart",
}
