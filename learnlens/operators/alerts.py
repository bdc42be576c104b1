"""Latency and burst alerts, for batch and for append-mode streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from learnlens.config import Rules
from learnlens.functions import rules as R
from learnlens.functions import times

ALERT_COLUMNS = ("alert_id", "alert_type", "user_id", "description", "triggered_at", "window_start")


def latency(metrics: DataFrame, rules: Rules) -> DataFrame:
    """One alert per run-time metric above the limit."""
    slow = metrics.filter(
        (F.col("metric_type") == R.LATENCY_METRIC) & (F.col("value") > rules.latency_ms)
    )
    return slow.select(
        R.alert_key(F.lit(R.HIGH_LATENCY), F.col("metric_id")).alias("alert_id"),
        F.lit(R.HIGH_LATENCY).alias("alert_type"),
        "user_id",
        R.latency_text(F.col("value")).alias("description"),
        times.exact_time(F.col("timestamp")).alias("triggered_at"),
        F.lit(None).cast("timestamp").alias("window_start"),
    )


def activity(submissions: DataFrame) -> DataFrame:
    """What the burst rule looks at; a missing address counts as one address."""
    return submissions.filter(F.col("timestamp").isNotNull() & F.col("user_id").isNotNull()).select(
        F.col("timestamp").alias("event_time"),
        "user_id",
        "submission_id",
        F.coalesce("client_ip", F.lit(R.UNKNOWN_IP)).alias("client_ip"),
    )


def burst_windows(
    events: DataFrame, rules: Rules, approximate: bool = False, once_a_minute: bool = False
) -> DataFrame:
    """Submissions, addresses and last event per user and sliding window.

    Addresses are counted exactly.  A batch counts them per user, window and address first, then per user
    and window: all partial results are plain numbers, and a user with most of the rows is spread over many
    groups.  A stream, which is put under the watermark and emits a window once it is closed, keeps a
    third of these rows: one per user, address and pane, which closed panes bring to their three windows.
    ``approximate`` counts with sketches instead, see ``activity_panes``, which bounds the state
    of users with very many addresses.

    ``once_a_minute``: only windows that raise an alert, and of a user's that end in one minute only
    the first; a burst is in up to three sliding windows, and a long one in many.
    """
    if approximate:
        counted = pane_windows(activity_panes(events, rules), rules)
    else:
        counted = _exact_windows(events, rules)
    return _flat(_first_of_minute(counted, rules) if once_a_minute else counted)


def _exact_windows(events: DataFrame, rules: Rules) -> DataFrame:
    if events.isStreaming:
        return _exact_stream_windows(events.withWatermark("event_time", rules.watermark), rules)
    window = F.window("event_time", rules.burst_window, rules.burst_slide)
    return _added(_per_address(events, window, "window").groupBy("window", "user_id"), F.count("client_ip"))


def _exact_stream_windows(events: DataFrame, rules: Rules) -> DataFrame:
    """The state of a window holds its addresses, those of one user in half a minute."""
    panes = _per_address(events, F.window("event_time", rules.burst_slide), "pane")
    window = F.window(F.col("pane"), rules.burst_window, rules.burst_slide).alias("window")
    return _added(panes.groupBy(window, "user_id"), F.size(F.collect_set("client_ip")).cast("bigint"))


def _per_address(events: DataFrame, span: Column, name: str) -> DataFrame:
    return events.groupBy(span.alias(name), "user_id", "client_ip").agg(
        F.count("submission_id").alias("submissions"),
        F.max("event_time").alias("last_event"),
    )


def _added(groups: GroupedData, addresses: Column) -> DataFrame:
    return groups.agg(
        F.sum("submissions").alias(SUBMISSIONS),
        addresses.alias("distinct_ip_count"),
        F.max("last_event").alias("window_last_event"),
    )


SUBMISSIONS = "submission_count_30s"


def _flat(counted: DataFrame) -> DataFrame:
    return counted.select(
        "user_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        SUBMISSIONS,
        "distinct_ip_count",
        "window_last_event",
    )


def activity_panes(events: DataFrame, rules: Rules) -> DataFrame:
    """Submissions, last event and a sketch of the addresses per user and pane, a window as long as the slide.

    Every event is in one pane, where it is in three sliding windows.  Sketches are of fixed size and can be
    united, so panes can be stored and give windows of any number of panes later.
    """
    if events.isStreaming:
        events = events.withWatermark("event_time", rules.watermark)
    pane = F.window("event_time", rules.burst_slide).alias("pane")
    return events.groupBy(pane, "user_id").agg(
        F.count("submission_id").alias("submissions"),
        F.max("event_time").alias("last_event"),
        F.hll_sketch_agg("client_ip", F.lit(rules.sketch_bits)).alias("addresses"),
    )


def pane_windows(panes: DataFrame, rules: Rules) -> DataFrame:
    """Sliding windows from panes: counts are added and sketches united.

    The standard error of a count of addresses is about ``0.8 / sqrt(2 ** sketch_bits)``; few are exact.
    """
    window = F.window(F.col("pane"), rules.burst_window, rules.burst_slide).alias("window")
    return _added(panes.groupBy(window, "user_id"), F.hll_sketch_estimate(F.hll_union_agg("addresses")))


def _first_of_minute(counted: DataFrame, rules: Rules) -> DataFrame:
    """Of each user's flagged windows whose last moment lies in one minute, the first."""
    minute = F.window(F.col("window"), "1 minute").alias("minute")
    names = [SUBMISSIONS, "distinct_ip_count", "window_last_event"]
    first = flagged(counted, rules).groupBy(minute, "user_id").agg(
        F.min("window.start").alias("start"),
        F.min("window.end").alias("end"),
        *[F.min_by(name, "window.start").alias(name) for name in names],
    )
    return first.withColumn("window", F.struct("start", "end"))


def flagged(windows: DataFrame, rules: Rules) -> DataFrame:
    """Windows that are too busy or have too many addresses."""
    return windows.filter(
        (F.col(SUBMISSIONS) >= rules.burst_submissions) | (F.col("distinct_ip_count") > rules.burst_ips)
    )


def bursts(windows: DataFrame, rules: Rules) -> DataFrame:
    """One alert per window that is too busy or has too many addresses."""
    count, ips = F.col(SUBMISSIONS), F.col("distinct_ip_count")
    start = F.unix_seconds("window_start").cast("string")
    return flagged(windows, rules).select(
        R.alert_key(F.lit(R.CHEAT_DETECTED), F.col("user_id"), start).alias("alert_id"),
        F.lit(R.CHEAT_DETECTED).alias("alert_type"),
        "user_id",
        R.burst_text(count, ips).alias("description"),
        F.col("window_last_event").alias("triggered_at"),
        "window_start",
    )


def every_alert(latency_alerts: DataFrame, burst_alerts: DataFrame) -> DataFrame:
    return latency_alerts.unionByName(burst_alerts)


def corrections(complete: DataFrame, raised: DataFrame) -> DataFrame:
    """Alerts that should have been raised, and those whose counts were too low because rows came late."""
    told = raised.select("alert_id", "description")
    return complete.join(told, ["alert_id", "description"], "left_anti").select(*ALERT_COLUMNS)
