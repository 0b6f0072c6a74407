"""Checked queries over readings, features, series and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import fahrenheit_to_celsius, machine_type as type_of
from sensorloom.functions.scoring import severity
from sensorloom.operators import features as feature_ops
from sensorloom.operators import forest
from sensorloom.operators import forecast as forecast_ops
from sensorloom.operators.detectors import (
    as_series, compare_methods as compare, compare_runs as compare_sets, detect, trailing_baseline as baseline)
from sensorloom.operators.detectors import detect_upload as upload
from sensorloom.operators.ewma import ewma as ewma_of
from sensorloom.operators.ordered import ordered
from sensorloom.operators.series import quartiles as quartiles_of
from sensorloom.operators.series import series_stats as stats_of
from sensorloom.operators.series import to_series, trend_slope as slope_of
from sensorloom.plans.checks import check, rounded, rounded_sql
from sensorloom.plans.fixtures import (
    ANOMALY_COLUMNS, Fixtures, long_sql, profile_sql, rolling_sql, severity_sql, with_shapes, zscore_sql)
from sensorloom.schema import PARAMETERS, SERIES_KEY
from sensorloom.sources.tables import readings_of

ANOMALY_TEXT = ["severity", "is_trending", "method"]
KEYS = "machine_id, parameter"
VALUES = [*PARAMETERS, *[f"{p}_roll_avg" for p in PARAMETERS], *[f"{p}_roc" for p in PARAMETERS]]


@check(with_shapes(f"SELECT machine_id, dataset_id, ts, row_id, {', '.join(PARAMETERS)} FROM ew", "ew"))
def readings_scan(x: Fixtures) -> DataFrame:
    return readings_of(x.wide_events())


# Raw text planted with junk: bad times, other layouts, blank and padded ids, non-numbers.
RAW_SQL = """
  SELECT event_id AS row_id,
    CASE event_id % 11 WHEN 0 THEN 'not a time' WHEN 1 THEN strftime(ts, '%m/%d/%Y %H:%M:%S')
         WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
    CASE event_id % 13 WHEN 0 THEN '   ' WHEN 1 THEN '  ' || user_id || ' ' ELSE user_id::VARCHAR END AS machine_id,
    CASE event_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '1.5d' WHEN 2 THEN 'nan' WHEN 3 THEN ' ' || value || ' '
         ELSE value::VARCHAR END AS temperature,
    value::VARCHAR AS pressure, CASE event_id % 5 WHEN 0 THEN '' ELSE value::VARCHAR END AS vibration,
    CASE event_id % 3 WHEN 0 THEN '1e3' WHEN 1 THEN '-.5' ELSE '+7.' END AS rpm,
    CASE event_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'fahrenheit' ELSE 'C' END AS temp_unit
  FROM events"""
NUMBER_SQL = r"CASE WHEN regexp_matches({0}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') " \
             r"THEN TRY_CAST(trim({0}) AS DOUBLE) END"


def raw_events(x: Fixtures) -> DataFrame:
    e, text = F.col("event_id"), F.col("value").cast("string")
    ts = F.col("ts")
    time = (F.when(e % 11 == 0, "not a time").when(e % 11 == 1, F.date_format(ts, "MM/dd/yyyy HH:mm:ss"))
            .when(e % 11 == 2, F.date_format(ts, "yyyy/MM/dd HH:mm"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    user = F.col("user_id").cast("string")
    machine = F.when(e % 13 == 0, "   ").when(e % 13 == 1, F.concat(F.lit("  "), user, F.lit(" "))).otherwise(user)
    temperature = (F.when(e % 7 == 0, "n/a").when(e % 7 == 1, "1.5d").when(e % 7 == 2, "nan")
                   .when(e % 7 == 3, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text))
    return x.table("events").select(
        e.alias("row_id"), time.alias("timestamp"), machine.alias("machine_id"), temperature.alias("temperature"),
        text.alias("pressure"), F.when(e % 5 == 0, "").otherwise(text).alias("vibration"),
        F.when(e % 3 == 0, "1e3").when(e % 3 == 1, "-.5").otherwise("+7.").alias("rpm"),
        F.when(e % 3 == 0, "F").when(e % 3 == 1, "fahrenheit").otherwise("C").alias("temp_unit"))


@check(f"""
  WITH raw AS ({RAW_SQL}), typed AS (
    SELECT nullif(trim(machine_id), '') AS machine_id, row_id,
      coalesce(try_strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(timestamp, '%Y/%m/%d %H:%M'),
               try_strptime(timestamp, '%m/%d/%Y %H:%M:%S')) AS ts,
      {NUMBER_SQL.format('temperature')} AS t, {NUMBER_SQL.format('pressure')} AS pressure,
      {NUMBER_SQL.format('vibration')} AS vibration, {NUMBER_SQL.format('rpm')} AS rpm, temp_unit FROM raw)
  SELECT machine_id, ts, row_id,
    round(CASE WHEN upper(temp_unit) LIKE 'F%' THEN (t - 32) * 5.0 / 9.0 ELSE t END, 6) AS temperature,
    pressure, vibration, rpm FROM typed WHERE ts IS NOT NULL AND machine_id IS NOT NULL""")
def clean_readings(x: Fixtures) -> DataFrame:
    return rounded(feature_ops.clean(raw_events(x)), "temperature")


@check("""SELECT event_id, round(CASE WHEN event_type IN ('view', 'click') THEN (value - 32) * 5.0 / 9.0
          ELSE value END, 6) AS celsius FROM events""")
def fahrenheit_to_celsius_units(x: Fixtures) -> DataFrame:
    kind = F.col("event_type")
    unit = F.when(kind == "view", "f").when(kind == "click", "Fahrenheit").when(kind == "error", "celsius")
    return x.table("events").select(
        "event_id", F.round(fahrenheit_to_celsius(F.col("value"), unit), 6).alias("celsius"))


@check(with_shapes("SELECT id, name, machine_type FROM md", "md"))
def machine_type(x: Fixtures) -> DataFrame:
    return x.machines().select("id", "name", type_of(F.upper("name")).alias("machine_type"))


@check(with_shapes(f"SELECT * FROM ({long_sql('ew')})", "ew"))
def unpivot_parameters(x: Fixtures) -> DataFrame:
    return to_series(x.wide_events(), ["machine_id", "dataset_id", "ts", "row_id"])


@check(with_shapes("SELECT machine_id, dataset_id, ts, row_id, temperature, pressure, vibration, rpm FROM fb", "fb"))
def fill_forward_backward(x: Fixtures) -> DataFrame:
    return feature_ops.fill_backward(feature_ops.fill_forward(x.wide_events()))


@check(with_shapes(f"SELECT machine_id, dataset_id, ts, row_id, {rounded_sql(*VALUES)} FROM fw", "fw"))
def rolling_features(x: Fixtures) -> DataFrame:
    filled = feature_ops.fill_gaps(x.wide_events())
    return rounded(feature_ops.rate_of_change(feature_ops.rolling_mean(filled)), *VALUES)


@check(with_shapes(f"SELECT machine_id::VARCHAR AS machine_id, ts, row_id, {rounded_sql(*VALUES)} "
                   f"FROM ({rolling_sql('fb', 6)})", "fb"))
def transform(x: Fixtures) -> DataFrame:
    raw = x.wide_events().withColumnRenamed("ts", "timestamp").drop("dataset_id")
    return rounded(feature_ops.transform(raw, window=6), *VALUES)


@check(with_shapes(f"SELECT {KEYS}, n, {rounded_sql('mean', 'std', 'std_pop', 'low', 'high')} "
                   f"FROM ({profile_sql('fl')})", "fl"))
def series_stats(x: Fixtures) -> DataFrame:
    return rounded(stats_of(as_series(x.readings())), "mean", "std", "std_pop", "low", "high")


@check(with_shapes(f"SELECT {KEYS}, n, round(trend_slope, 6) AS trend_slope, abs(trend_slope) >= 1.0 AS is_trending "
                   f"FROM ({profile_sql('el')})", "el"))
def trend_slope(x: Fixtures) -> DataFrame:
    return slope_of(x.long_events()).withColumn("is_trending", F.abs("trend_slope") >= 1.0).withColumn(
        "trend_slope", F.round("trend_slope", 6))


QUARTILES_SQL = (f"SELECT {KEYS}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 "
                 f"FROM el WHERE value IS NOT NULL GROUP BY {KEYS}")


@check(with_shapes(f"SELECT {KEYS}, {rounded_sql('q1', 'q3')} FROM ({QUARTILES_SQL})", "el"))
def quartiles(x: Fixtures) -> DataFrame:
    return rounded(quartiles_of(x.long_events()), "q1", "q3")


@check(f"SELECT event_id, {severity_sql('value / 100.0', 4.5, 3.0 * 1.2)} AS severity FROM events")
def severity_buckets(x: Fixtures) -> DataFrame:
    return x.table("events").select("event_id", severity(F.col("value") / 100.0, 3.0).alias("severity"))


def _shown(anomalies: DataFrame) -> DataFrame:
    return rounded(anomalies, "z_score", "trend_slope")


SHOWN = ", ".join([*ANOMALY_COLUMNS, *ANOMALY_TEXT]) + ", " + rounded_sql("z_score", "trend_slope")


@check(with_shapes(f"SELECT {SHOWN} FROM ({zscore_sql('fl', 3.0, gate=3, signed=True, method='upload')})", "fl"))
def detect_upload(x: Fixtures) -> DataFrame:
    return _shown(upload(x.readings(), 3.0))


@check(with_shapes(f"SELECT {SHOWN} FROM ({zscore_sql('el', 3.0)})", "el"))
def detect_zscore(x: Fixtures) -> DataFrame:
    return _shown(detect(x.long_events(), "zscore"))


def scored_sql(rows: str, score: str, keep: str, method: str, severity: str) -> str:
    """Anomaly rows from ``rows`` (alias r) joined to the profile of their series (alias p)."""
    columns = ", ".join(f"r.{c}" for c in ANOMALY_COLUMNS)
    return (f"SELECT {columns}, {score} AS z_score, {severity} AS severity, abs(p.trend_slope) >= 1.0 AS is_trending, "
            f"p.trend_slope, '{method}' AS method FROM ({rows}) r JOIN ({profile_sql('el')}) p USING ({KEYS}) "
            f"WHERE p.n >= 5 AND {keep}")


def trailing_sql(window: int) -> str:
    frame = (f"OVER (PARTITION BY {KEYS} ORDER BY ts, row_id ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)")
    return (f"SELECT *, CASE WHEN count(value) {frame} >= {max(3, window // 2)} THEN avg(value) {frame} END AS base_mean, "
            f"CASE WHEN count(value) {frame} >= {max(3, window // 2)} AND min(value) {frame} < max(value) {frame} "
            f"THEN stddev_samp(value) {frame} END AS base_std FROM el")


ROLLING = scored_sql(trailing_sql(10), "abs((r.value - base_mean) / base_std)",
                     "abs((r.value - base_mean) / base_std) >= 3.0", "rolling_z",
                     severity_sql("abs((r.value - base_mean) / base_std)", 4.5, 3.0 * 1.2))


@check(with_shapes(f"SELECT {', '.join(ANOMALY_COLUMNS)}, {rounded_sql('base_mean', 'base_std')} "
                   f"FROM ({trailing_sql(8)})", "el"))
def trailing_baseline(x: Fixtures) -> DataFrame:
    o = ordered(x.long_events(), SERIES_KEY, look_back=8)
    return rounded(o.done(baseline(o, 8)), "base_mean", "base_std")


@check(with_shapes(f"SELECT {SHOWN} FROM ({ROLLING})", "el"))
def detect_rolling_z(x: Fixtures) -> DataFrame:
    return _shown(detect(x.long_events(), "rolling_z"))


def ewma_sql(window: int) -> str:
    a = 2.0 / (window + 1)
    return (f"SELECT *, list_reduce(list(value) OVER (PARTITION BY {KEYS} ORDER BY ts, row_id "
            f"ROWS UNBOUNDED PRECEDING), lambda acc, v: acc * {1 - a} + v * {a}) AS ewma FROM el")


EWMA = scored_sql(
    f"SELECT *, resid / resid_std AS z FROM (SELECT *, stddev_samp(resid) OVER (PARTITION BY {KEYS}) AS resid_std "
    f"FROM (SELECT *, abs(value - ewma) AS resid FROM ({ewma_sql(10)})))",
    "r.z", "r.resid_std > 0 AND r.z >= 3.0", "ewma", severity_sql("r.z", 4.5, 3.0 * 1.2))


@check(with_shapes(f"SELECT machine_id, row_id, round(ewma, 6) AS ewma FROM ({ewma_sql(10)})", "el"))
def ewma(x: Fixtures) -> DataFrame:
    return rounded(ewma_of(x.long_events(), 10), "ewma").select("machine_id", "row_id", "ewma")


@check(with_shapes(f"SELECT {SHOWN} FROM ({EWMA})", "el"))
def detect_ewma(x: Fixtures) -> DataFrame:
    return _shown(detect(x.long_events(), "ewma"))


OUTSIDE = "greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) / (q3 - q1)"
IQR = scored_sql(
    f"SELECT el.*, {OUTSIDE} AS z FROM el JOIN ({QUARTILES_SQL}) q USING ({KEYS}) WHERE q3 > q1",
    "r.z", "r.z > 0", "iqr", severity_sql("r.z", 1.5, 0.75))


@check(with_shapes(f"SELECT {SHOWN} FROM ({IQR})", "el"))
def detect_iqr(x: Fixtures) -> DataFrame:
    return _shown(detect(x.long_events(), "iqr"))


# The forest from its definition: every value of a series walks down every tree; the rows that a tree drew
# (weight) decide the cuts and the sizes of the leaves, and the path lengths of all trees are summed.
DIGEST_SQL = (f"list_reduce(list_prepend(0, list_transform(string_split(substr(md5({{0}}), 1, {forest.DIGITS}), ''), "
              f"lambda c: strpos('0123456789abcdef', c) - 1)), lambda a, b: a * 16 + b) / 16.0 ** {forest.DIGITS}")
LEAF_SQL = (f"CAST(round({forest.UNIT} * CASE WHEN size > 2 THEN 2 * (ln(size - 1) + {forest.EULER}) - 2 * (size - 1) / size "
            "WHEN size = 2 THEN 1.0 ELSE 0.0 END) AS BIGINT)")
FOREST_PARTS = {
    "drawn": f"SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY digest, value) - 1 AS pos FROM ("
             f"SELECT {KEYS}, value, md5(row_id::VARCHAR) AS digest, {DIGEST_SQL.format('row_id::VARCHAR')} AS share, "
             f"count(*) OVER (PARTITION BY {KEYS}) AS n FROM el WHERE value IS NOT NULL) "
             f"WHERE n >= 5 AND (n <= {2 * forest.POOL} OR share < {2.0 * forest.POOL} / n)",
    "pool": f"SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS pooled, least({forest.SAMPLE}, count(*) OVER (PARTITION BY {KEYS})) "
            f"AS size FROM drawn WHERE pos < {forest.POOL}",
    "trees": f"SELECT unnest(range({forest.TREES})) AS tree",
    "cuts": f"SELECT tree, node, {DIGEST_SQL.format(f"concat('{forest.SEED}:', tree, ':', node)")} AS share "
            f"FROM (SELECT tree, unnest(range({forest.SAMPLE})) AS node FROM trees)",
    "weights": f"SELECT {KEYS}, tree, value, count(*) AS weight FROM pool, trees "
               f"WHERE (pos - tree * size + {forest.POOL} * pooled) % pooled < size GROUP BY ALL",
    "sizes": f"SELECT {KEYS}, any_value(size) AS drawn, greatest(ceil(log2(greatest(any_value(size), 2))), 1) AS most "
             f"FROM pool GROUP BY {KEYS}",
    "walks": f"SELECT {KEYS}, tree, value, coalesce(weight, 0) AS weight, 1 AS node, 0 AS depth, drawn, most FROM "
             f"(SELECT DISTINCT {KEYS}, value FROM el WHERE value IS NOT NULL) JOIN sizes USING ({KEYS}) CROSS JOIN trees "
             f"LEFT JOIN weights USING ({KEYS}, tree, value) UNION ALL "
             f"SELECT {KEYS}, tree, value, weight, 2 * node + CASE WHEN value > CASE WHEN cut < high THEN cut ELSE low END "
             "THEN 1 ELSE 0 END, depth + 1, drawn, most FROM (SELECT *, low + share * (high - low) AS cut FROM ("
             "SELECT *, min(value) FILTER (weight > 0) OVER w AS low, max(value) FILTER (weight > 0) OVER w AS high "
             f"FROM walks WHERE depth < most WINDOW w AS (PARTITION BY {KEYS}, tree, node)) JOIN cuts USING (tree, node) "
             "WHERE low < high)",
    "ends": f"SELECT {KEYS}, value, any_value(drawn) AS drawn, sum(depth * {forest.UNIT} + {LEAF_SQL}) AS paths FROM ("
            f"SELECT *, sum(weight) OVER w AS size, min(value) FILTER (weight > 0) OVER w AS low, "
            "max(value) FILTER (weight > 0) OVER w AS high "
            f"FROM walks WINDOW w AS (PARTITION BY {KEYS}, tree, depth, node)) WHERE low = high OR depth = most GROUP BY {KEYS}, value",
    "isolated": f"SELECT *, stddev_pop(raw) OVER w AS raw_std, avg(raw) OVER w AS raw_mean, "
                f"quantile_cont(raw, {1 - forest.contamination(3.0)}) OVER w AS raw_cut "
                f"FROM (SELECT el.*, 2.0 ** (-(paths / {float(forest.TREES * forest.UNIT)}) / norm) AS raw FROM el JOIN ("
                f"SELECT *, greatest(CASE WHEN drawn > 2 THEN 2 * (ln(drawn - 1) + {forest.EULER}) - 2 * (drawn - 1) / drawn "
                f"WHEN drawn = 2 THEN 1.0 ELSE 0.0 END, 1e-12) AS norm FROM ends) USING ({KEYS}, value)) "
                f"WINDOW w AS (PARTITION BY {KEYS})",
}
DEVIATION = "abs(r.raw - r.raw_mean) / CASE WHEN r.raw_std > 0 THEN r.raw_std ELSE 1.0 END"
FOREST = scored_sql("SELECT * FROM isolated", f"greatest({DEVIATION}, 0.5)", "r.raw > r.raw_cut", "isolation_forest",
                    severity_sql(DEVIATION, 1.5, 0.75))


@check(with_shapes(f"SELECT {SHOWN} FROM ({FOREST})", "el", extra=FOREST_PARTS))
def detect_isolation_forest(x: Fixtures) -> DataFrame:
    return _shown(detect(x.long_events(), "isolation_forest"))


METHOD_SQL = {"zscore": zscore_sql("el", 3.0), "rolling_z": ROLLING, "ewma": EWMA, "iqr": IQR, "isolation_forest": FOREST}


@check(with_shapes(
    "SELECT m.method, count(a.severity) AS anomalies, count(DISTINCT a.machine_id) AS machines_flagged, "
    "count(*) FILTER (a.severity = 'HIGH') AS high, count(*) FILTER (a.severity = 'MEDIUM') AS medium, "
    "count(*) FILTER (a.severity = 'MONITOR') AS monitor "
    "FROM (VALUES ('zscore'), ('rolling_z'), ('ewma'), ('iqr'), ('isolation_forest')) m(method) LEFT JOIN ("
    + " UNION ALL ".join(f"SELECT machine_id, severity, method FROM ({s})" for s in METHOD_SQL.values())
    + ") a ON a.method = m.method GROUP BY m.method", "el", extra=FOREST_PARTS))
def compare_methods(x: Fixtures) -> DataFrame:
    return compare(x.long_events(), list(METHOD_SQL))


@check(with_shapes(
    "SELECT coalesce(a.severity, b.severity) AS severity, coalesce(a.n, 0) AS left_count, "
    "coalesce(b.n, 0) AS right_count, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches "
    f"FROM (SELECT severity, count(*) AS n FROM ({METHOD_SQL['zscore']}) GROUP BY 1) a "
    f"FULL JOIN (SELECT severity, count(*) AS n FROM ({METHOD_SQL['iqr']}) GROUP BY 1) b ON a.severity = b.severity",
    "el"))
def compare_runs(x: Fixtures) -> DataFrame:
    return compare_sets(detect(x.long_events(), "zscore"), detect(x.long_events(), "iqr"))


HOURS = "(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY machine_id))) / 3.6e9"


@check(with_shapes(f"SELECT machine_id, row_id, round({HOURS}, 6) AS hours FROM el", "el"))
def hours_since_first(x: Fixtures) -> DataFrame:
    return rounded(forecast_ops.with_hours(x.long_events()), "hours").select("machine_id", "row_id", "hours")


@check(with_shapes(
    "SELECT machine_id, parameter, unit, round(current, 2) AS current, service_limit, "
    "round(per_day, 4) AS slope_per_day, round(eta, 1) AS eta_days, "
    "CASE WHEN current >= service_limit THEN 'exceeded' WHEN eta <= 120 THEN 'approaching' ELSE 'stable' END AS status "
    "FROM (SELECT *, CASE WHEN current < service_limit AND per_day > 0 THEN (service_limit - current) / per_day END AS eta "
    "FROM (SELECT machine_id, parameter, 'units' AS unit, 75.0::DOUBLE AS service_limit, "
    "regr_slope(value, hours) * 24.0 AS per_day, avg(value) FILTER (back <= 3) AS current, count(*) AS n "
    f"FROM (SELECT *, {HOURS} AS hours, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC, row_id DESC) AS back "
    f"FROM el WHERE value IS NOT NULL) GROUP BY {KEYS}) WHERE n >= 5)", "el"))
def forecast(x: Fixtures) -> DataFrame:
    return forecast_ops.forecast(x.long_events(), {"value": (75.0, "units")})


LIMITS_SQL = "(VALUES ('temperature', 75.0::DOUBLE, '°C'), ('vibration', 4.0, 'mm/s'), ('pressure', 165.0, 'bar'))"


@check(with_shapes(
    "SELECT machine_id, parameter, unit, round(current, 2) AS current, service_limit, "
    "round(per_day, 4) AS slope_per_day, round(eta, 1) AS eta_days, "
    "CASE WHEN current >= service_limit THEN 'exceeded' WHEN eta <= 120 THEN 'approaching' ELSE 'stable' END AS status "
    "FROM (SELECT *, CASE WHEN current < service_limit AND per_day > 0 THEN (service_limit - current) / per_day END AS eta "
    "FROM (SELECT machine_id, parameter, any_value(unit) AS unit, any_value(service_limit) AS service_limit, "
    "regr_slope(value, hours) * 24.0 AS per_day, avg(value) FILTER (back <= 3) AS current, count(*) AS n "
    f"FROM (SELECT *, {HOURS} AS hours, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC, row_id DESC) AS back "
    f"FROM fl JOIN {LIMITS_SQL} l(parameter, service_limit, unit) USING (parameter) WHERE value IS NOT NULL) "
    f"GROUP BY {KEYS}) WHERE n >= 5)", "fl"))
def forecast_parameters(x: Fixtures) -> DataFrame:
    return forecast_ops.forecast(as_series(x.readings()))
