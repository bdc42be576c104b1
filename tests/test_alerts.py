from collections import defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from learnlens.config import Rules
from learnlens.operators import alerts

RULES = Rules()
METRIC = "metric_id string, user_id string, metric_type string, value double, timestamp double"
SUBMISSION = "submission_id string, user_id string, client_ip string, timestamp timestamp"
T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def events(spark, *data):
    """(id, user, ip, second) rows."""
    df = spark.createDataFrame([(i, u, ip, None if s is None else at(s)) for i, u, ip, s in data], SUBMISSION)
    return alerts.activity(df)


def windows(spark, *data, **options):
    found = alerts.burst_windows(events(spark, *data), RULES, **options).collect()
    return {(r.user_id, (r.window_start - T0).total_seconds()): r for r in found}


def test_latency_is_strictly_above_the_limit(spark):
    metrics = spark.createDataFrame(
        [
            ("a", "u", "execution_time_ms", 5000.0, 1704067200.5),
            ("b", "u", "execution_time_ms", 5000.01, 1704067200.5),
            ("c", "u", "execution_time_ms", None, 1.0),
            ("d", "u", "memory_kb", 9000.0, 1.0),
            ("e", None, "execution_time_ms", 6000.0, None),
        ],
        METRIC,
    )
    found = {r.description: r for r in alerts.latency(metrics, RULES).collect()}
    assert set(found) == {
        "Execution latency exceeded 5s: 5000.01 ms",
        "Execution latency exceeded 5s: 6000.0 ms",
    }
    assert found["Execution latency exceeded 5s: 5000.01 ms"].triggered_at == at(0.5)
    assert found["Execution latency exceeded 5s: 6000.0 ms"].triggered_at is None


def test_each_event_is_in_three_windows(spark):
    found = windows(spark, ("1", "u", "a", 0), ("2", "v", "a", 10), ("3", "w", "a", 29), ("4", "x", "a", 30))
    starts = defaultdict(set)
    for user, start in found:
        starts[user].add(start)
    assert starts == {"u": {-20, -10, 0}, "v": {-10, 0, 10}, "w": {0, 10, 20}, "x": {10, 20, 30}}


def test_rule(spark):
    cases = {
        "one": [("1", "one", "a", 0)],
        "same address": [("2", "same address", "a", 0), ("3", "same address", "a", 0)],
        "two addresses": [("4", "two addresses", "a", 0), ("5", "two addresses", "b", 0)],
        "no ids": [(None, "no ids", "a", 0), (None, "no ids", "b", 0)],
        "no ids, one address": [(None, "no ids, one address", "a", 0), (None, "no ids, one address", "a", 0)],
        "no address": [(None, "no address", None, 0), (None, "no address", "a", 0)],
    }
    data = [row for rows in cases.values() for row in rows]
    data += [("9", None, "a", 0), ("9", "no time", "a", None)]
    flagged = alerts.bursts(alerts.burst_windows(events(spark, *data), RULES), RULES).collect()
    texts = {r.user_id: r.description for r in flagged}
    assert texts == {
        "same address": "Window anomaly: submissions_30s=2, distinct_ips=1",
        "two addresses": "Window anomaly: submissions_30s=2, distinct_ips=2",
        "no ids": "Window anomaly: submissions_30s=0, distinct_ips=2",
        "no address": "Window anomaly: submissions_30s=0, distinct_ips=2",
    }


def test_windows_against_brute_force_with_a_hot_user(spark):
    data = [
        (str(i), "hot" if i % 3 == 0 else f"u{i % 17}", f"ip{(i * i) % 23}", (i * 13) % 700) for i in range(2000)
    ]
    expected = defaultdict(list)
    for i, user, ip, second in data:
        for back in (0, 10, 20):
            expected[user, second - second % 10 - back].append((i, ip, second))
    found = windows(spark, *data)
    assert set(found) == set(expected)
    for key, members in expected.items():
        row = found[key]
        assert row.submission_count_30s == len(members)
        assert row.distinct_ip_count == len({ip for _, ip, _ in members})
        assert row.window_last_event == at(max(s for *_, s in members))


def test_sketch_is_close_on_many_addresses(spark):
    data = [(str(i), "u", f"ip{i}", i % 10) for i in range(5000)]
    row = windows(spark, *data, approximate=True)["u", 0]
    assert abs(row.distinct_ip_count - 5000) < 0.2 * 5000


def test_alert_ids_repeat_and_tell_windows_apart(spark):
    data = [("1", "u", "a", 0), ("2", "u", "a", 1)]
    first = alerts.bursts(alerts.burst_windows(events(spark, *data), RULES), RULES).collect()
    again = alerts.bursts(alerts.burst_windows(events(spark, *data), RULES), RULES).collect()
    assert {r.alert_id for r in first} == {r.alert_id for r in again}
    assert len({r.alert_id for r in first}) == 3


def test_union_keeps_duplicates(spark):
    metrics = spark.createDataFrame([("a", "u", "execution_time_ms", 9e3, 1.0)] * 2, METRIC)
    latency = alerts.latency(metrics, RULES)
    bursts = alerts.bursts(alerts.burst_windows(events(spark), RULES), RULES)
    assert alerts.every_alert(latency, bursts).count() == 2
    assert latency.first().triggered_at.replace(tzinfo=timezone.utc).timestamp() == 1.0


def many_addresses(spark, number):
    return spark.range(2 * number).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 20).alias("event_time"),
        F.lit("u").alias("user_id"),
        F.col("id").cast("string").alias("submission_id"),
        (F.col("id") % number).cast("string").alias("client_ip"),
    )


def test_sketches_of_very_many_addresses(spark):
    rules = Rules()
    exact = alerts.burst_windows(many_addresses(spark, 100_000), rules).collect()
    rough = {r.window_start: r for r in alerts.burst_windows(many_addresses(spark, 100_000), rules, True).collect()}
    assert len(exact) == len(rough) == 4
    for row in exact:
        other = rough[row.window_start]
        assert other.submission_count_30s == row.submission_count_30s
        assert other.window_last_event == row.window_last_event
        assert abs(other.distinct_ip_count / row.distinct_ip_count - 1) < 0.05  # four standard errors


def test_stored_panes_give_the_same_windows(spark, tmp_path):
    rules, events = Rules(), many_addresses(spark, 500)
    alerts.activity_panes(events, rules).write.parquet(str(tmp_path / "panes"))
    stored = spark.read.parquet(str(tmp_path / "panes"))
    assert stored.count() == 2  # a row per user and ten seconds
    windows = alerts.pane_windows(stored, rules).select("user_id", "window", alerts.SUBMISSIONS, "distinct_ip_count")
    once = alerts.pane_windows(alerts.activity_panes(events, rules), rules).select(*windows.columns)
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, once.collect()))


def test_one_alert_for_a_burst(spark):
    rules = Rules()
    seconds = [0, 1, 2, 100, 101, 125]
    rows = [(datetime(2024, 1, 1) + timedelta(seconds=s), "u", f"s{i}", "ip") for i, s in enumerate(seconds)]
    events = spark.createDataFrame(rows, "event_time timestamp, user_id string, submission_id string, client_ip string")
    starts = [r.window_start for r in alerts.burst_windows(events, rules, once_a_minute=True).collect()]
    seconds = sorted(int((s - datetime(2024, 1, 1)).total_seconds()) for s in starts)
    # windows from -20, -10 and 0; 80 to 100; 100 holds 125 too: the first of the minutes 0, 1 and 2
    assert seconds == [-20, 80, 100]
    all_starts = [r.window_start for r in alerts.bursts(alerts.burst_windows(events, rules), rules).collect()]
    assert len(all_starts) == 6 and set(starts) <= set(all_starts)
