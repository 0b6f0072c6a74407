"""Reading, cleaning and featuring raw sensor rows."""

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import parse_ts, to_number
from sensorloom.operators.features import clean, fill_gaps, transform
from sensorloom.schema import PARAMETERS
from sensorloom.sources.csv import read_sensor_csv, records, scan_lines, split_files
from sensorloom.sources.synth import synth_sensors

HEADER = "timestamp,machine_id,temperature,pressure,vibration,rpm"


def raw(spark, temperature, unit=None, machine="M1"):
    start = dt.datetime(2026, 1, 1)
    rows = [((start + dt.timedelta(hours=i)).isoformat(), machine, None if t is None else str(t), str(100 + i),
             str(1 + i / 10), "1500") for i, t in enumerate(temperature)]
    frame = spark.createDataFrame(rows, "timestamp string, machine_id string, temperature string, pressure string, "
                                        "vibration string, rpm string")
    return frame if unit is None else frame.withColumn("temp_unit", F.lit(unit))


def test_missing_columns_are_named(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("timestamp,machine_id\n1,M1\n")
    with pytest.raises(ValueError, match="missing required column.*temperature, pressure, vibration, rpm"):
        read_sensor_csv(spark, str(path))


def test_header_case_and_extra_columns(spark, tmp_path):
    path = tmp_path / "ok.csv"
    path.write_text(" Timestamp ,MACHINE_ID,Temperature,Pressure,Vibration,RPM,note\n"
                    "2026-01-01T00:00:00,007,60,100,1,1500,hello\n")
    row = read_sensor_csv(spark, str(path)).first()
    assert row["machine_id"] == "007" and row["note"] == "hello"


def test_nulls_filled_and_features_added(spark):
    rows = transform(raw(spark, [60, 61, None, 63, 64, 65]), window=3).orderBy("ts").collect()
    assert [r["temperature"] for r in rows] == [60, 61, 61, 63, 64, 65]
    assert [r["temperature_roc"] for r in rows] == [0, 1, 0, 2, 1, 1]
    assert rows[3]["temperature_roll_avg"] == pytest.approx((61 + 61 + 63) / 3)
    assert all(r[p] is not None for r in rows for p in PARAMETERS)


def test_leading_nulls_take_the_first_value_and_empty_columns_stay_null(spark):
    rows = transform(raw(spark, [None, None, 5, None])).orderBy("ts").collect()
    assert [r["temperature"] for r in rows] == [5, 5, 5, 5]
    # a median fill after both fills could only see columns without any value
    assert [r["temperature"] for r in transform(raw(spark, [None, None])).collect()] == [None, None]


@pytest.mark.parametrize("unit, expected", [("F", 60.0), ("fahr", 60.0), ("C", 140.0), (None, 140.0)])
def test_fahrenheit(spark, unit, expected):
    rows = transform(raw(spark, [140] * 6, unit)).collect()
    assert {round(r["temperature"], 1) for r in rows} == {expected}


def test_times_and_numbers(spark):
    texts = [("2026-01-02T03:04:05", 2026), ("2026-01-02 03:04", 2026), ("2026/01/02 03:04", 2026),
             ("01/02/2026 03:04:05", 2026), ("02-Jan-2026 03:04:05", 2026), ("soon", None), ("", None),
             ("2026-13-45", None), ("99/99/2026 03:04", None)]
    found = spark.createDataFrame(texts, "t string, y int").select(F.year(parse_ts(F.col("t"))).alias("p"), "y").collect()
    assert [r["p"] for r in found] == [r["y"] for r in found]
    numbers = [("1.5", 1.5), (" 2 ", 2.0), ("1e3", 1000.0), (".5", 0.5), ("+7.", 7.0), ("1.5d", None), ("nan", None),
               ("", None), ("1,5", None), ("abc", None)]
    found = spark.createDataFrame(numbers, "t string, y double").select(to_number(F.col("t")).alias("p"), "y").collect()
    assert [r["p"] for r in found] == [r["y"] for r in found]


def test_rows_without_time_or_machine_are_dropped(spark):
    frame = raw(spark, [1]).union(raw(spark, [2], machine="  ")).union(
        raw(spark, [3]).withColumn("timestamp", F.lit("junk"))).union(raw(spark, [4], machine=" M2 "))
    assert sorted(r["machine_id"] for r in clean(frame).collect()) == ["M1", "M2"]


def test_many_files_keep_their_own_headers(spark):
    lines = [("a", HEADER), ("a", "2026-01-01T00:00:00,M1,60,100,1,1500"),
             ("b", "rpm,TEMP_UNIT,machine_id,vibration,pressure,temperature,timestamp"),
             ("b", '1400,F,"M,2",2,90,140,2026-01-01T00:00:00'), ("b", ',,M3,2,,140,2026-01-01T00:00:00'),
             ("c", "timestamp,machine_id,temperature"), ("c", "2026-01-01T00:00:00,M3,1"), ("d", "no header here")]
    good, bad = split_files(spark.createDataFrame(lines, "file string, value string"))
    rows = {r["file"]: r for r in good.filter("machine_id <> 'M3'").collect()}
    blank = good.filter("machine_id = 'M3'").first()
    assert (blank["rpm"], blank["pressure"], blank["temperature"]) == ("", "", "140")
    assert rows["a"]["temperature"] == "60" and rows["a"]["temp_unit"] is None
    assert rows["b"]["machine_id"] == "M,2" and rows["b"]["temp_unit"] == "F" and rows["b"]["rpm"] == "1400"
    errors = {r["file"]: r["error"] for r in bad.collect()}
    assert set(errors) == {"c", "d"} and "pressure, vibration, rpm" in errors["c"]


def small_ranges(spark, path, size):
    """The lines of ``path``, read in byte ranges of ``size``."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = scan_lines(spark, path).withColumn("at", F.monotonically_increasing_id())
        return spark.createDataFrame(lines.collect(), lines.schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_quoted_line_breaks_across_ranges(spark, tmp_path, size):
    """Records of many byte ranges equal those of the reader that takes a file in one task, and of Python's."""
    rng, want = random.Random(size), []
    for f in range(3):
        notes = ["pl\n\nain", 'say ""\n"" x'.replace('""', '"'), "a,\nb", "", 'x"y', "\n", "é\nü,\n,", '"', "M,1", "long " * 30 + "\n"]
        rows = [[f"2026-01-0{f + 1}T00:00:00", rng.choice(notes) + str(i), "60", rng.choice(notes), "1", "1500"] for i in range(60)]
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerows([HEADER.split(","), *rows])
        want += [tuple(r) for r in rows]
    lines = small_ranges(spark, str(tmp_path), size)
    assert size > 1000 or lines.select("file", "start").distinct().count() > 20
    raw, bad = split_files(records(lines))
    found = [tuple("" if v is None else v for v in r) for r in raw.select(*HEADER.split(",")).collect()]
    assert sorted(found) == sorted(want) and bad.isEmpty()
    one_task = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"', nullValue="\0", emptyValue="")
    assert sorted(tuple(v or "" for v in r) for r in one_task.collect()) == sorted(found)


def test_stray_quotes_join_no_lines(spark, tmp_path):
    """A quote inside a bare value, or after a closed one, opens nothing; a quote that never ends takes the rest."""
    text = 'a,5" pipe,b\n"x"y,1\n"one\ntwo"z,"three ""\nfour",5\nplain\n\nlast,"open\n1,2\n'
    (tmp_path / "stray.csv").write_text(text)
    for size in (8, 1 << 20):
        found = sorted(r["value"] for r in records(small_ranges(spark, str(tmp_path), size)).collect())
        assert found == sorted(['a,5" pipe,b', '"x"y,1', '"one\ntwo"z,"three ""\nfour",5', "plain", "", 'last,"open\n1,2'])


def test_synthetic_readings(spark):
    rows = synth_sensors(spark)
    assert rows.count() == 960
    typed = fill_gaps(clean(rows))
    means = {r["machine_id"]: r for r in typed.groupBy("machine_id").agg(
        F.avg("pressure").alias("p"), F.avg("rpm").alias("r"), F.avg("temperature").alias("t")).collect()}
    assert means["MOTOR-001"]["p"] == 0.0 and means["VALVE-001"]["r"] == 0.0
    assert means["PUMP-001"]["t"] > 62 + 62 * 0.25 / 4
    blanks = rows.filter(" or ".join(f"{p} is null" for p in PARAMETERS)).count()
    assert 0 < blanks < 40
    again = synth_sensors(spark)
    assert rows.exceptAll(again).isEmpty()


def test_lines_of_one_file_stay_in_many_tasks(spark):
    """A large file is parsed by as many tasks as read it, however few files there are."""
    lines = spark.range(0, 800, 1, 8).select(
        F.lit("one").alias("file"), F.spark_partition_id().cast("long").alias("start"), F.col("id").alias("at"),
        F.when(F.col("id") == 0, HEADER).otherwise(F.concat(F.lit("2026-01-01T00:00:00,M1,1,2,3,"), F.col("id"))).alias("value"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the sizes of the inputs were not known
    try:
        good, bad = split_files(records(lines))
        found = good.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == 8 and sum(r["n"] for r in found) == 799 and bad.isEmpty()
