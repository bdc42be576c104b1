"""The nightly job: raw messages to typed tables to reports and models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens import schemas
from learnlens.config import Rules, Settings
from learnlens.functions import times
from learnlens.operators import alerts, dropout, features, gold, recommend
from learnlens.operators.dedup import latest_by_key
from learnlens.session import job_folder, staged
from learnlens.sources import payloads
from learnlens.sources.index import distinct_days
from learnlens.sources.tables import Warehouse

Step = Callable[[DataFrame], DataFrame]



def silver_submissions(bronze: DataFrame) -> DataFrame:
    """Typed submissions, one row per id: the copy that came last."""
    wanted = schemas.fields_of(
        schemas.SUBMISSION,
        *("user_id", "problem_id", "status", "execution_time_ms", "memory_kb", "timestamp"),
    )
    parsed = payloads.parse(bronze, wanted, "submission_id", "ingest_timestamp")
    latest = latest_by_key(parsed, ("submission_id",), ("ingest_timestamp",))
    epoch = F.col("timestamp")
    timed = latest.withColumns({"timestamp": times.whole_second(epoch), "day": times.utc_day(epoch)})
    return timed.select(*schemas.TABLES["silver_submissions"].names)


def typed_metrics(bronze: DataFrame) -> DataFrame:
    """Typed metrics, one row per id: the copy that came last, whether or not it names a user."""
    wanted = schemas.fields_of(schemas.METRIC, "user_id", "metric_type", "value", "timestamp")
    parsed = payloads.parse(bronze, wanted, "metric_id", "ingest_timestamp")
    latest = latest_by_key(parsed, ("metric_id",), ("ingest_timestamp",))
    return latest.withColumn("day", times.utc_day(F.col("timestamp"))).select(
        *schemas.TABLES["silver_metrics"].names
    )


def silver_metrics(bronze: DataFrame) -> DataFrame:
    """Typed metrics of known users."""
    return typed_metrics(bronze).filter("user_id IS NOT NULL")


def attempt_totals(silver: DataFrame) -> DataFrame:
    return features.total_attempts(features.attempts(silver, "day"), "user_id", "problem_id", "day")


def login_totals(silver: DataFrame) -> DataFrame:
    return features.login_seconds(silver, "user_id", "day")


def _refresh(
    warehouse: Warehouse,
    ingest_days: Sequence[str] | None,
    bronze: str,
    silver: str,
    typed: Step,
    wanted: str | None,
    totals: str,
    summed: Step,
) -> list[str]:
    """Bring one silver table and its daily totals up to date; returns the tables written.

    The last copy of an id counts, and is then left out if it is not ``wanted``.
    """
    raw = warehouse.read_bronze(bronze, days=None if ingest_days is None else [str(d) for d in ingest_days])
    if ingest_days is None:
        warehouse.write_days({silver: lambda _: typed(raw).filter(wanted or "true"), totals: summed})
        return [silver, totals]

    fresh = staged(typed(raw), silver)
    keys = list(schemas.TABLE_KEYS[silver])
    ids = fresh.select(*keys)
    # an id may have been stored under another day, which then loses it
    days = staged(distinct_days(warehouse.days_holding(silver, ids), fresh), f"{silver}-days")
    if days.isEmpty():
        return []
    touched = warehouse.read_touched(silver, days)
    merged = touched.join(ids, keys, "left_anti").unionByName(fresh.filter(wanted or "true"))
    warehouse.write_days({silver: lambda _: merged, totals: summed}, days)
    return [silver, totals]


def refresh(warehouse: Warehouse, ingest_days: Sequence[str] | None = None) -> list[str]:
    """Bring typed tables and daily totals up to date, whole or by the days that messages came on."""
    written = _refresh(
        warehouse,
        ingest_days,
        *("bronze_submissions", "silver_submissions", silver_submissions, None),
        *("attempt_totals", attempt_totals),
    )
    return written + _refresh(
        warehouse,
        ingest_days,
        *("bronze_metrics", "silver_metrics", typed_metrics, "user_id IS NOT NULL"),
        *("login_totals", login_totals),
    )


def late_alerts(warehouse: Warehouse, rules: Rules, ingest_days: Sequence[str] | None = None) -> DataFrame:
    """Burst alerts over the windows that the stream has closed, where it missed rows that came late.

    The stream drops a row whose windows are closed, but raw messages keep it.  Windows are counted
    again from the messages that came on ``ingest_days`` (all without it), the last copy of each, and
    compared with the alerts raised.  Give the day before too, so that windows are whole.
    """
    wanted = schemas.fields_of(schemas.SUBMISSION, "submission_id", "user_id", "client_ip", "timestamp")
    raw = warehouse.read_bronze("bronze_submissions", days=None if ingest_days is None else [str(d) for d in ingest_days])
    parsed = payloads.parse(raw.drop("submission_id"), wanted, "ingest_timestamp")
    latest = latest_by_key(parsed, ("submission_id",), ("ingest_timestamp",))
    events = staged(alerts.activity(latest.withColumn("timestamp", times.whole_second(F.col("timestamp")))), "activity")
    closed = events.agg((F.max("event_time") - F.expr(f"INTERVAL {rules.watermark}")).alias("end")).first()["end"]
    windows = alerts.burst_windows(events, rules).filter(F.col("window_end") <= F.lit(closed))
    return alerts.corrections(alerts.bursts(windows, rules), warehouse.read_alerts())


def run_batch(
    spark: SparkSession,
    settings: Settings,
    dimensions: Mapping[str, DataFrame],
    ingest_days: Sequence[str] | None = None,
) -> list[str]:
    """Rebuild the typed tables and the seven reports; returns the names of the tables written.

    Raw messages are parsed once and submissions are summed once, per user, problem and day;
    features, heatmap and recommender start from these totals.  Every step reads a stored
    table, so a lost executor repeats one step; what was staged on the way is removed at the end.  A report whose metadata is
    missing is left as it was, but for the heatmap, which then has no categories.

    With ``ingest_days`` only the messages that came on those days are parsed, and only the
    event days are replaced that they belong to now or belonged to before.  Their copies win over
    stored ones, so nights are run in the order of their days.
    """
    with job_folder(spark, "nightly"):
        return _run(spark, settings, dimensions, ingest_days)


def _run(
    spark: SparkSession,
    settings: Settings,
    dimensions: Mapping[str, DataFrame],
    ingest_days: Sequence[str] | None,
) -> list[str]:
    warehouse = Warehouse(spark, settings.root)
    rules, learning = settings.rules, settings.learning

    written = refresh(warehouse, ingest_days)

    def report(df: DataFrame, name: str) -> None:
        for key in schemas.TABLE_KEYS[name]:
            df = df.filter(F.col(key).isNotNull())
        df = df.withColumn("last_updated", F.current_timestamp())
        if settings.reset_gold:
            warehouse.write_snapshot(df, name)
        else:
            warehouse.upsert(df, name)
        written.append(name)

    totals = warehouse.read("attempt_totals")
    login = features.login_minutes(warehouse.read("login_totals"))
    warehouse.write_snapshot(features.user_features(totals, login), "user_features")
    written.append("user_features")
    users = warehouse.read("user_features")

    report(gold.engagement(users, rules), "gold_engagement_scores")
    report(gold.adaptive_profiles(users, rules), "gold_adaptive_difficulty_profiles")
    report(dropout.predictions(users, rules, learning), "gold_dropout_predictions")
    interactions = staged(gold.interactions(totals), "interactions")
    if not interactions.isEmpty():
        report(recommend.next_problem(interactions, learning), "gold_next_problem_recommendations")

    problems, ratings = dimensions.get("problems"), dimensions.get("ratings")
    transactions = dimensions.get("transactions")
    if problems is None or problems.isEmpty():
        nothing = spark.createDataFrame([], "problem_id string, category string")
        report(gold.difficulty_heatmap(totals, nothing), "gold_difficulty_heatmap")
    else:
        report(gold.difficulty_heatmap(totals, problems), "gold_difficulty_heatmap")
        if ratings is not None and not ratings.isEmpty():
            report(gold.instructor_report(ratings, problems), "gold_instructor_report_card")
    if transactions is not None and not transactions.isEmpty():
        report(gold.subscription_revenue(transactions), "gold_subscription_revenue")
    for name in written:
        warehouse.expire(name, settings.keep_snapshots)
    return written
