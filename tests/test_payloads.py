import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from learnlens import schemas
from learnlens.functions import times
from learnlens.sources import payloads

GOOD = {
    "submission_id": "s1",
    "user_id": "u1",
    "problem_id": "p1",
    "status": "Pass",
    "execution_time_ms": 5,
    "memory_kb": 2048,
    "client_ip": "10.10.0.11",
    "timestamp": 1704067207.9,
}


def raw(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "raw_payload string")


def test_submission_time_is_cut_to_the_second_and_day_is_utc(spark):
    row = payloads.submissions(raw(spark, json.dumps(GOOD))).first()
    assert row.timestamp == datetime(2024, 1, 1, 0, 0, 7)
    assert row.day == date(2024, 1, 1)
    assert (row.execution_time_ms, row.memory_kb, row.client_ip) == (5, 2048, "10.10.0.11")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Ho_Chi_Minh", "America/Los_Angeles"])
def test_day_does_not_depend_on_the_session_zone(spark, zone):
    late = dict(GOOD, timestamp=1704153599.5)  # 2024-01-01T23:59:59.5Z
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert payloads.submissions(raw(spark, json.dumps(late))).first().day == date(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("epoch", [-1e12, 1e18, float("inf"), float("nan"), None])
def test_a_broken_clock_gives_a_null_time_and_no_error(spark, epoch):
    df = spark.createDataFrame([(epoch,)], "t double")
    row = df.select(
        times.whole_second(F.col("t")).alias("a"),
        times.exact_time(F.col("t")).alias("b"),
        times.utc_day(F.col("t")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (None, None, None)


BAD = {
    "not json": "not json",
    "": "empty",
    "   ": "empty",
    "{}": "no key",
    "[1, 2]": "no key",
    '{"user_id": "u1"}': "no key",
    json.dumps(GOOD)[:40]: "not json",
}


def test_quarantine_takes_what_has_no_key_and_says_why(spark):
    df = raw(spark, json.dumps(GOOD), None, *BAD)
    found = {
        r.raw_payload: r.reason
        for r in payloads.quarantine(df, schemas.SUBMISSION, "submission_id").collect()
    }
    assert found == {None: "empty", **BAD}


def test_bronze_keeps_every_message(spark):
    df = raw(spark, json.dumps(GOOD), None, *BAD)
    rows = payloads.bronze(df, schemas.SUBMISSION, "submission_id").collect()
    assert len(rows) == 2 + len(BAD)
    assert [r.submission_id for r in rows if r.accepted] == ["s1"]
    assert all(r.reason is None for r in rows if r.accepted)
    assert all(r.reason for r in rows if not r.accepted)


EDGES = [
    json.dumps(GOOD),
    json.dumps(dict(GOOD, execution_time_ms=5.7)),
    json.dumps(dict(GOOD, execution_time_ms="5")),
    json.dumps(dict(GOOD, status=7)),
    json.dumps(dict(GOOD, client_ip=None)),
    json.dumps({"submission_id": "s9", "extra": {"deep": [1, 2]}}),
    json.dumps(GOOD)[:60],
    "not json",
    "{}",
]


@pytest.mark.parametrize("names", [("submission_id",), ("user_id", "problem_id", "status"), ("client_ip", "timestamp")])
def test_parsing_some_fields_equals_parsing_all(spark, names):
    df = raw(spark, *EDGES).coalesce(1)
    some = payloads.parse(df, schemas.fields_of(schemas.SUBMISSION, *names)).collect()
    everything = payloads.parse(df, schemas.SUBMISSION).select(*names).collect()
    assert some == everything


def test_a_badly_typed_field_spoils_only_itself(spark):
    row = payloads.parse(raw(spark, json.dumps(dict(GOOD, execution_time_ms=5.7))), schemas.SUBMISSION).first()
    assert row.execution_time_ms is None
    assert (row.submission_id, row.status) == ("s1", "Pass")


def test_metrics_need_a_user(spark):
    metric = {"metric_id": "m", "user_id": "u", "metric_type": "memory_kb", "value": 1, "timestamp": 2.5}
    df = raw(spark, json.dumps(metric), json.dumps(dict(metric, user_id=None)), "junk")
    assert [tuple(r) for r in payloads.metrics(df).collect()] == [("m", "u", "memory_kb", 1.0, 2.5)]


def test_decode_takes_binary_and_text(spark):
    binary = spark.createDataFrame([(bytearray(b"x\xc3\xa9"),)], "value binary")
    assert payloads.decode(binary).first().raw_payload == "xé"
    assert payloads.decode(spark.createDataFrame([("y",)], "value string")).first().raw_payload == "y"
