"""The four continuous queries.

None keeps a driver-side loop over rows.  Every micro-batch is stored under its number, so a replayed
one counts once, and every ``compact_every`` batches what came is folded: messages and alerts into
large files by day, the leaderboard's changes into one row per user.  A failed write fails the query, and the
next start replays it from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from learnlens import schemas
from learnlens.config import Settings
from learnlens.functions import times
from learnlens.operators import alerts, leaderboard
from learnlens.session import stream_session
from learnlens.sources import payloads
from learnlens.sources.tables import Warehouse
from learnlens.streaming.source import event_source


def _writer(df: DataFrame, settings: Settings, name: str, checkpoint: str, mode: str, available_now: bool):
    warehouse = Warehouse(df.sparkSession, settings.root)
    location = f"{settings.checkpoints}/generation={warehouse.generation()}/{checkpoint}"
    writer = (
        df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", location)
    )
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=settings.trigger_interval) if settings.trigger_interval else writer


def _start_log(
    rows: DataFrame, settings: Settings, table: str, checkpoint: str, available_now: bool
) -> StreamingQuery:
    """Append the rows of every micro-batch to a log, and fold it now and then."""

    def store(batch: DataFrame, batch_id: int) -> None:
        log = Warehouse(batch.sparkSession, settings.root).log(table)
        log.write(batch, batch_id)
        if (batch_id + 1) % settings.compact_every == 0:
            log.compact(batch_id)

    writer = _writer(rows, settings, f"stream_{table}", checkpoint, "append", available_now)
    return writer.foreachBatch(store).start()


def _start_bronze(
    messages: DataFrame,
    settings: Settings,
    table: str,
    schema: StructType,
    checkpoint: str,
    available_now: bool,
) -> StreamingQuery:
    rows = payloads.bronze(payloads.decode(messages), schema, schemas.BRONZE_KEYS[table])
    return _start_log(rows, settings, table, checkpoint, available_now)


def start_bronze_submissions(
    messages: DataFrame, settings: Settings, available_now: bool = False
) -> StreamingQuery:
    return _start_bronze(
        messages, settings, "bronze_submissions", schemas.SUBMISSION, "bronze", available_now
    )


def start_bronze_metrics(
    messages: DataFrame, settings: Settings, available_now: bool = False
) -> StreamingQuery:
    return _start_bronze(
        messages, settings, "bronze_metrics", schemas.METRIC, "system/bronze_metrics", available_now
    )


def start_leaderboard(
    messages: DataFrame, settings: Settings, available_now: bool = False
) -> StreamingQuery:
    """Solved counts per user over all time: state without watermark, update mode."""
    table = "gold_live_leaderboard"
    wanted = schemas.fields_of(schemas.SUBMISSION, "user_id", "problem_id", "status")
    counts = leaderboard.solved_counts(payloads.parse(payloads.decode(messages), wanted))

    def store(changed: DataFrame, batch_id: int) -> None:
        warehouse = Warehouse(changed.sparkSession, settings.root)
        stamped = changed.withColumns(
            {
                "total_solved": F.coalesce("total_solved", F.lit(0)),
                "last_updated": F.current_timestamp(),
            }
        )
        warehouse.write_changes(stamped, table, batch_id)
        if (batch_id + 1) % settings.compact_every == 0:
            warehouse.fold_changes(table, batch_id)

    writer = _writer(counts, settings, f"stream_{table}", "gold", "update", available_now)
    return writer.foreachBatch(store).start()


def alert_stream(submission_messages: DataFrame, metric_messages: DataFrame, settings: Settings) -> DataFrame:
    """Latency alerts at once, burst alerts when the watermark closes their window."""
    rules = settings.rules
    metrics = payloads.parse(payloads.decode(metric_messages), schemas.METRIC)
    wanted = schemas.fields_of(
        schemas.SUBMISSION, "submission_id", "user_id", "client_ip", "timestamp"
    )
    submissions = payloads.parse(payloads.decode(submission_messages), wanted).withColumn(
        "timestamp", times.whole_second(F.col("timestamp"))
    )
    events = alerts.activity(submissions)
    windows = alerts.burst_windows(events, rules, settings.approximate_addresses, settings.alert_once_a_minute)
    both = alerts.every_alert(alerts.latency(metrics, rules), alerts.bursts(windows, rules))
    return both.withColumn("triggered_at", F.coalesce("triggered_at", F.current_timestamp()))


def start_alerts(
    submission_messages: DataFrame,
    metric_messages: DataFrame,
    settings: Settings,
    available_now: bool = False,
) -> StreamingQuery:
    rows = alert_stream(submission_messages, metric_messages, settings)
    rows = rows.withColumn("raised_day", F.to_date(F.current_timestamp()))
    return _start_log(rows, settings, "gold_system_alerts", "system/alerts", available_now)


def start_all(session: SparkSession, settings: Settings, available_now: bool = False) -> list[StreamingQuery]:
    """Start the four queries over the configured source, in a session of ``stream_session``.

    With ``stream_reset`` they begin anew: new checkpoints, and leaderboard and alerts empty
    unless they are to be kept.  Raw messages are always kept.
    """
    if settings.stream_reset:
        Warehouse(session, settings.root).open_generation(settings.stream_reset_keeps_tables)

    def messages(topic: str) -> DataFrame:
        return event_source(session, settings, topic)

    submissions, metrics = settings.submissions_topic, settings.metrics_topic
    return [
        start_bronze_submissions(messages(submissions), settings, available_now),
        start_leaderboard(messages(submissions), settings, available_now),
        start_bronze_metrics(messages(metrics), settings, available_now),
        start_alerts(messages(submissions), messages(metrics), settings, available_now),
    ]


def run_until_one_ends(spark: SparkSession, settings: Settings) -> None:
    """Run the four queries until any of them ends, then stop the others."""
    session = stream_session(spark, settings)
    queries = start_all(session, settings)
    try:
        session.streams.awaitAnyTermination()
    finally:
        for query in queries:
            query.stop()
