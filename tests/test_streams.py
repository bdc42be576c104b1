import json
import os
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from learnlens import schemas
from learnlens.config import Settings
from learnlens.operators import alerts, leaderboard
from learnlens.plans import catalogue
from learnlens.session import stream_session
from learnlens.sources import payloads
from learnlens.sources.driver_tables import DriverTables
from learnlens.sources.tables import Warehouse
from learnlens.streaming import queries as streams
from learnlens.streaming.source import event_source, kafka_options

T0 = 1704067200


def submission(number, user="u", second=0.0, ip="10.10.0.11", status="Pass", problem="p1"):
    return {
        "submission_id": f"s{number}",
        "user_id": user,
        "problem_id": problem,
        "status": status,
        "execution_time_ms": 10,
        "memory_kb": 2048,
        "client_ip": ip,
        "timestamp": T0 + second,
    }


def metric(number, value=9000.0, kind="execution_time_ms", user="u", second=0.0):
    return {
        "metric_id": f"m{number}",
        "user_id": user,
        "metric_type": kind,
        "value": value,
        "timestamp": T0 + second,
    }


class Topics:
    """Message files; each call adds one file, so one call is one micro-batch."""

    def __init__(self, folder):
        self.folder, self.files = folder, 0
        for topic in ("raw_submissions", "system_metrics"):
            (folder / topic).mkdir(parents=True)

    def add(self, topic, *messages):
        lines = [m if isinstance(m, str) else json.dumps(m) for m in messages]
        self.files += 1
        staging = self.folder / f".{self.files}"
        staging.write_text("\n".join(lines) + "\n")
        os.utime(staging, (1_700_000_000 + self.files,) * 2)  # files are taken in this order
        staging.rename(self.folder / topic / f"{self.files:05d}.json")


@pytest.fixture()
def topics(tmp_path):
    return Topics(tmp_path / "topics")


@pytest.fixture()
def settings(tmp_path, root):
    return Settings(
        root=root,
        source_kind="files",
        source_path=str(tmp_path / "topics"),
        max_files_per_trigger=1,
        stream_shuffle_partitions=2,
        compact_every=2,
    )


def run(spark, settings):
    for query in streams.start_all(stream_session(spark, settings), settings, available_now=True):
        query.awaitTermination()
    return Warehouse(spark, settings.root)


def board(warehouse):
    rows = warehouse.read_current("gold_live_leaderboard").collect()
    return {r.user_id: r.total_solved for r in rows}


def burst_starts(warehouse):
    rows = warehouse.read_alerts().filter("alert_type = 'CHEAT_DETECTED'").collect()
    start = datetime(2024, 1, 1)
    return sorted((r.user_id, int((r.window_start - start).total_seconds())) for r in rows)


def test_four_queries_over_several_batches_and_a_restart(spark, settings, topics):
    topics.add("raw_submissions", submission(1), submission(2, "v"), "torn {", submission(3, status="Runtime Error"))
    topics.add("raw_submissions", submission(4, second=1), submission(5, second=200))
    topics.add("system_metrics", metric(1), metric(2, 5000.0), metric(3, kind="memory_kb"), "junk")
    warehouse = run(spark, settings)
    assert board(warehouse) == {"u": 3, "v": 1}
    assert burst_starts(warehouse) == [("u", -20), ("u", -10), ("u", 0)]

    topics.add("raw_submissions", submission(6, "v", second=201), submission(7, "w", second=202))
    topics.add("system_metrics", metric(4, 7000.5, second=3.25))
    warehouse = run(spark, settings)  # from the checkpoints: nothing is taken twice
    assert board(warehouse) == {"u": 3, "v": 2, "w": 1}
    latency = warehouse.read_alerts().filter("alert_type = 'HIGH_LATENCY'")
    assert sorted((r.description, r.triggered_at) for r in latency.collect()) == [
        ("Execution latency exceeded 5s: 7000.5 ms", datetime(2024, 1, 1) + timedelta(seconds=3.25)),
        ("Execution latency exceeded 5s: 9000.0 ms", datetime(2024, 1, 1)),
    ]
    kept = warehouse.read_bronze("bronze_submissions")
    assert sorted(r.submission_id for r in kept.collect()) == [f"s{i}" for i in range(1, 8)]
    dead = warehouse.read_bronze("bronze_submissions", accepted=False).collect()
    assert [(r.raw_payload, r.reason) for r in dead] == [("torn {", "not json")]
    assert warehouse.read_bronze("bronze_metrics").count() == 4
    assert warehouse.read_bronze("bronze_metrics", accepted=False).count() == 1


def test_streams_agree_with_batch_over_closed_windows(spark, settings, topics):
    messages = [
        submission(i, f"u{i % 4}", second=(i * 7) % 600, ip=f"10.10.0.{i % 5}", status="Pass" if i % 3 else "Runtime Error")
        for i in range(300)
    ]
    messages.sort(key=lambda m: m["timestamp"])
    for i in range(0, 300, 60):
        topics.add("raw_submissions", *messages[i : i + 60])
    topics.add("system_metrics", *[metric(i, 4000.0 + 100 * i) for i in range(30)])
    warehouse = run(spark, settings)

    raw = spark.createDataFrame([(json.dumps(m),) for m in messages], "raw_payload string")
    parsed = payloads.submissions(raw)
    expected_board = {r.user_id: r.total_solved for r in leaderboard.solved_counts(parsed).collect()}
    assert board(warehouse) == expected_board

    rules = settings.rules
    last = max(m["timestamp"] for m in messages) - T0
    windows = alerts.burst_windows(alerts.activity(parsed), rules)
    closed = windows.filter(windows.window_end <= datetime(2024, 1, 1) + timedelta(seconds=last - 120))
    expected = {r.alert_id: r.description for r in alerts.bursts(closed, rules).collect()}
    found = warehouse.read_alerts().filter("alert_type = 'CHEAT_DETECTED'").collect()
    assert len(found) == len(expected)
    assert {r.alert_id: r.description for r in found} == expected

    raw_metrics = spark.createDataFrame(
        [(json.dumps(metric(i, 4000.0 + 100 * i)),) for i in range(30)], "raw_payload string"
    )
    slow = alerts.latency(payloads.parse(raw_metrics, schemas.METRIC), rules)
    latency = warehouse.read_alerts().filter("alert_type = 'HIGH_LATENCY'")
    assert {r.alert_id for r in latency.collect()} == {r.alert_id for r in slow.collect()}


def test_the_sketch_agrees_on_few_addresses(spark, settings, topics):
    topics.add("raw_submissions", submission(1), submission(2, ip="10.10.0.12"), submission(3, second=5))
    topics.add("raw_submissions", submission(4, "w", second=500))
    warehouse = run(spark, replace(settings, approximate_addresses=True))
    found = warehouse.read_alerts().filter("alert_type = 'CHEAT_DETECTED'").collect()
    assert {r.description for r in found} == {"Window anomaly: submissions_30s=3, distinct_ips=2"}
    assert burst_starts(warehouse) == [("u", -20), ("u", -10), ("u", 0)]


def test_a_failed_write_stops_the_query_and_is_replayed(spark, settings, topics, monkeypatch):
    topics.add("raw_submissions", submission(1), submission(2, "v"))
    topics.add("raw_submissions", submission(3))
    session = stream_session(spark, settings)
    store, calls = Warehouse.write_changes, []

    def broken(self, df, name, batch_id):
        store(self, df, name, batch_id)
        calls.append(batch_id)
        if calls == [0, 1]:
            raise OSError("disk went away after the write")

    monkeypatch.setattr(Warehouse, "write_changes", broken)

    def start():
        messages = event_source(session, settings, "raw_submissions")
        return streams.start_leaderboard(messages, settings, available_now=True)

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    start().awaitTermination()
    assert calls == [0, 1, 1]
    assert board(Warehouse(spark, settings.root)) == {"u": 2, "v": 1}


def test_late_rows_count_until_their_window_is_closed(spark, settings, topics):
    def pair(number, user, second):
        return submission(number, user, second=second), submission(number + 1, user, second=second + 1)

    topics.add("raw_submissions", submission(1, second=0))
    topics.add("raw_submissions", submission(2, "w", second=300), submission(3, second=1))
    # Spark filters late rows by the watermark of the batch before, so these still count
    topics.add("raw_submissions", submission(4, "w", second=301), *pair(10, "x", 2))
    # and these come after their windows were closed
    topics.add("raw_submissions", submission(5, "w", second=302), *pair(20, "y", 2))
    topics.add("raw_submissions", submission(6, "w", second=900))
    warehouse = run(spark, settings)
    found = burst_starts(warehouse)
    assert [s for u, s in found if u == "u"] == [-20, -10, 0]
    assert [s for u, s in found if u == "x"] == [-20, -10, 0]
    assert [s for u, s in found if u == "y"] == []
    assert [s for u, s in found if u == "w"] == [280, 290, 300]
    assert board(warehouse) == {"u": 2, "w": 4, "x": 2, "y": 2}  # the leaderboard has no watermark


def test_an_event_is_in_the_state_once_not_once_a_window(spark, settings, topics):
    # one user, five addresses, sixty submissions within ten seconds
    topics.add("raw_submissions", *[submission(i, second=i % 10, ip=f"10.0.0.{i % 5}") for i in range(60)])
    session = stream_session(spark, settings)
    submissions = event_source(session, settings, "raw_submissions")
    query = streams.start_alerts(submissions, event_source(session, settings, "system_metrics"), settings, True)
    query.awaitTermination()
    rows = [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]]
    assert max(rows) == 5 and sum(rows) <= 5 + 3
    topics.add("raw_submissions", submission(90, "w", second=500))
    found = run(spark, settings).read_alerts().filter("user_id = 'u'").collect()
    assert {r.description for r in found} == {"Window anomaly: submissions_30s=60, distinct_ips=5"} and len(found) == 3


def test_rows_of_the_state_need_not_be_counted(spark, settings):
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    assert stream_session(spark, settings).conf.get(name) == "true"
    assert stream_session(spark, replace(settings, count_state_rows=False)).conf.get(name) == "false"
    assert not catalogue._stream(DriverTables(spark, "/none"))[1].count_state_rows


def test_events_that_come_together_are_dealt_evenly(spark, tmp_path):
    one = spark.range(1000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS user_id", "'click' AS event_type",
        "1.0D AS value", "'{}' AS props",
    ).coalesce(1)
    arrivals = DriverTables(spark, str(tmp_path / "arrivals"))
    for _ in range(2):
        catalogue._arrive(one, arrivals)
    files = arrivals.table("events").groupBy(F.input_file_name()).count().collect()
    assert len(files) == 2 * spark.sparkContext.defaultParallelism and sum(f["count"] for f in files) == 2000
    assert max(f["count"] for f in files) < 2 * 1000 / spark.sparkContext.defaultParallelism


def test_open_windows_wait(spark, settings, topics):
    topics.add("raw_submissions", submission(1), submission(2, second=1))
    assert burst_starts(run(spark, settings)) == []


def test_fresh_start_clears_leaderboard_and_alerts_but_not_raw_messages(spark, settings, topics):
    topics.add("raw_submissions", submission(1), submission(2, second=1), submission(3, second=300))
    topics.add("system_metrics", metric(1))
    assert board(run(spark, settings)) == {"u": 3}

    # the topic still holds its messages, so a fresh start takes them again, once
    warehouse = run(spark, replace(settings, stream_reset=True))
    assert board(warehouse) == {"u": 3}
    assert burst_starts(warehouse) == [("u", -20), ("u", -10), ("u", 0)]
    assert warehouse.read_alerts().count() == 4
    assert warehouse.read_bronze("bronze_submissions").count() == 6  # both runs, deduplicated by the batch job

    topics.add("raw_submissions", submission(4, "v", second=301))
    assert board(run(spark, settings)) == {"u": 3, "v": 1}  # goes on in the new generation


def test_fresh_start_may_keep_the_tables(spark, settings, topics):
    topics.add("raw_submissions", submission(1), submission(2, "v"))
    topics.add("system_metrics", metric(1))
    run(spark, settings)
    topics.add("raw_submissions", submission(3, "w"))
    again = replace(settings, stream_reset=True, stream_reset_keeps_tables=True)
    warehouse = run(spark, again)
    assert board(warehouse) == {"u": 1, "v": 1, "w": 1}
    alerts_ = [r.alert_id for r in warehouse.read_alerts().collect()]
    assert len(alerts_) == 2 and len(set(alerts_)) == 1  # taken twice, under the same id


def test_parquet_messages(spark, settings, tmp_path):
    for topic, message in (("raw_submissions", submission(1)), ("system_metrics", metric(1))):
        rows = spark.createDataFrame([(json.dumps(message),)], "value string")
        rows.write.parquet(str(tmp_path / "topics" / topic))
    warehouse = run(spark, replace(settings, source_format="parquet"))
    assert board(warehouse) == {"u": 1}
    assert warehouse.read_alerts().count() == 1


def test_kafka_options():
    assert kafka_options(Settings(root="x"), "raw_submissions") == {
        "kafka.bootstrap.servers": "localhost:9092",
        "subscribe": "raw_submissions",
        "startingOffsets": "latest",
        "failOnDataLoss": "true",
    }
    capped = Settings(root="x", max_offsets_per_trigger=1200, fail_on_data_loss=False)
    assert kafka_options(capped, "t")["maxOffsetsPerTrigger"] == "1200"
    assert kafka_options(capped, "t")["failOnDataLoss"] == "false"


def test_unknown_source(spark, root):
    with pytest.raises(ValueError):
        event_source(spark, Settings(root=root, source_kind="pigeon"), "t")
    with pytest.raises(ValueError):
        event_source(spark, Settings(root=root, source_kind="files"), "t")


def test_the_callers_session_is_left_alone(spark, settings):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session = stream_session(spark, settings)
    assert session.conf.get("spark.sql.shuffle.partitions") == "2"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
