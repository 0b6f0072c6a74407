"""Every checked query against its SQL, and published counts."""

import pytest
from conftest import DATA
from oracle import connect, differences

import __spark_entry__ as contract
from sensorloom.operators.detectors import detect, detect_upload
from sensorloom.operators.features import fill_gaps
from sensorloom.plans.checks import ORACLES, QUERIES

CON = connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert differences(frame, CON, ORACLES[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def severities(frame):
    found = {r["severity"]: r["count"] for r in frame.groupBy("severity").count().collect()}
    return tuple(found.get(s, 0) for s in ("HIGH", "MEDIUM", "MONITOR"))


@pytest.mark.parametrize("method, expected", [
    ("zscore", (3, 6, 6)), ("rolling_z", (20, 4, 9)), ("ewma", (17, 16, 24)), ("iqr", (10, 6, 32))])
def test_counts_by_method(fixtures, method, expected):
    assert severities(detect(fixtures.long_events(), method)) == expected


def test_counts_of_uploads_and_fleet(fixtures):
    assert severities(detect_upload(fill_gaps(fixtures.wide_events()))) == (6, 9, 27)
    assert severities(fixtures.anomalies()) == (15, 12, 22)


def test_entry_is_the_fleet(spark):
    rows = contract.entry(spark)
    assert rows.count() == 17 and rows.columns[0] == "id"
