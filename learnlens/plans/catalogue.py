"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from learnlens import schemas
from learnlens.config import Learning, Rules, Settings
from learnlens.functions import times
from learnlens.operators import (
    alerts,
    dedup,
    dropout,
    features,
    gold,
    leaderboard,
    numbering,
    recommend,
)
from learnlens.plans import batch, serving
from learnlens.plans.boards import Boards
from learnlens.session import new_folder, staged, stream_session
from learnlens.sources import payloads
from learnlens.sources.dimensions import read_dimension
from learnlens.sources.driver_tables import DriverTables
from learnlens.sources.tables import Warehouse
from learnlens.streaming import queries as streams

RULES, LEARNING = Rules(), Learning()
Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def query(function: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
    """Register ``function`` under its name; the session is pinned to UTC when it runs."""

    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(DriverTables(spark, folder))

    _REGISTRY[function.__name__] = run
    return function


# raw to typed -------------------------------------------------------------------------


@query
def silver_submissions(t: DriverTables) -> DataFrame:
    parsed = payloads.submissions(payloads.decode(t.submission_messages()))
    return parsed.select(*schemas.TABLES["silver_submissions"].names)


@query
def silver_metrics(t: DriverTables) -> DataFrame:
    return payloads.metrics(payloads.decode(t.metric_messages()))


@query
def quarantined_payloads(t: DriverTables) -> DataFrame:
    """A topic that carries chat turns and web pages among the submissions."""
    strays = t.table("conversations").select(F.col("text").alias("value")).unionByName(
        t.table("pages").select(F.col("html").alias("value"))
    )
    topic = t.submission_messages().select(F.col("value").cast("string")).unionByName(strays)
    return payloads.quarantine(payloads.decode(topic), schemas.SUBMISSION, "submission_id")


@query
def deduplicated_bronze(t: DriverTables) -> DataFrame:
    """A topic read twice over: every message and its replay give one typed row."""
    once = payloads.keyed(
        payloads.decode(t.submission_messages()), schemas.SUBMISSION, "submission_id"
    )
    replayed = once.withColumn("ingest_timestamp", F.timestamp_seconds(F.lit(1))).unionByName(
        once.withColumn("ingest_timestamp", F.timestamp_seconds(F.lit(2)))
    )
    return batch.silver_submissions(replayed)


@query
def latest_by_key(t: DriverTables) -> DataFrame:
    return dedup.latest_by_key(t.table("lineitem"), ("l_orderkey", "l_linenumber"), ("l_shipdate",))


@query
def metadata_problems(t: DriverTables) -> DataFrame:
    """Problems kept as documents with their own key, read back with the columns a board needs."""
    path = new_folder(t.spark, "metadata")
    t.problems().withColumnRenamed("problem_id", "_id").write.json(path)
    wanted = ("problem_id", "title", "category", "difficulty", "time_limit_ms")
    return read_dimension(t.spark, "problems", path, wanted, file_format="json")


# features and reports -----------------------------------------------------------------


def _login(t: DriverTables) -> DataFrame:
    return features.login_minutes(features.login_seconds(t.metrics(), "user_id"))


def _features(t: DriverTables) -> DataFrame:
    return features.user_features(features.attempts(t.submissions()), _login(t))


def _heatmap(t: DriverTables) -> DataFrame:
    return gold.difficulty_heatmap(features.attempts(t.submissions()), t.problems())


@query
def login_minutes(t: DriverTables) -> DataFrame:
    return _login(t)


@query
def attempt_totals(t: DriverTables) -> DataFrame:
    return batch.attempt_totals(t.submissions())


@query
def user_features(t: DriverTables) -> DataFrame:
    return _features(t)


@query
def engagement_scores(t: DriverTables) -> DataFrame:
    return gold.engagement(_features(t), RULES)


@query
def difficulty_heatmap(t: DriverTables) -> DataFrame:
    return _heatmap(t)


@query
def subscription_revenue(t: DriverTables) -> DataFrame:
    return gold.subscription_revenue(t.transactions())


@query
def instructor_report_card(t: DriverTables) -> DataFrame:
    return gold.instructor_report(t.ratings(), t.taught_problems())


@query
def adaptive_profiles(t: DriverTables) -> DataFrame:
    return gold.adaptive_profiles(_features(t), RULES)


# models -------------------------------------------------------------------------------


@query
def dropout_labels(t: DriverTables) -> DataFrame:
    return features.with_label(_features(t), RULES).select("user_id", "label")


@query
def dropout_class_balance(t: DriverTables) -> DataFrame:
    return features.class_balance(features.with_label(_features(t), RULES))


@query
def dropout_constant_fallback(t: DriverTables) -> DataFrame:
    return dropout.constant(features.with_label(_features(t), RULES), RULES)


def _predictions(t: DriverTables) -> DataFrame:
    return dropout.predictions(staged(_features(t), "features"), RULES, LEARNING)


@query
def dropout_predictions(t: DriverTables) -> DataFrame:
    return _predictions(t)


@query
def als_interactions(t: DriverTables) -> DataFrame:
    return gold.interactions(features.attempts(t.submissions()))


def _recommendations(t: DriverTables) -> DataFrame:
    interactions = gold.interactions(features.attempts(t.submissions()))
    return recommend.next_problem(staged(interactions, "interactions"), LEARNING)


@query
def next_problem_recommendations(t: DriverTables) -> DataFrame:
    return _recommendations(t)


# leaderboard and alerts ---------------------------------------------------------------


def _windows(t: DriverTables, approximate: bool = False) -> DataFrame:
    return alerts.burst_windows(alerts.activity(t.submissions()), RULES, approximate)


def _alerts(t: DriverTables) -> DataFrame:
    return alerts.every_alert(
        alerts.latency(t.metrics(), RULES), alerts.bursts(_windows(t), RULES)
    )


@query
def live_leaderboard(t: DriverTables) -> DataFrame:
    return leaderboard.solved_counts(t.submissions())


@query
def cohort_leaderboard(t: DriverTables) -> DataFrame:
    return leaderboard.by_cohort(leaderboard.solved_counts(t.submissions()), t.users())


@query
def latency_alerts(t: DriverTables) -> DataFrame:
    return alerts.latency(t.metrics(), RULES)


@query
def cheat_windows(t: DriverTables) -> DataFrame:
    return _windows(t)


@query
def cheat_windows_approx(t: DriverTables) -> DataFrame:
    return _windows(t, approximate=True)


@query
def cheat_alerts(t: DriverTables) -> DataFrame:
    return alerts.bursts(_windows(t), RULES)


@query
def system_alerts(t: DriverTables) -> DataFrame:
    return _alerts(t)


@query
def cheat_alerts_once_a_minute(t: DriverTables) -> DataFrame:
    return alerts.bursts(alerts.burst_windows(alerts.activity(t.submissions()), RULES, once_a_minute=True), RULES)


@query
def windows_of_unknown_addresses(t: DriverTables) -> DataFrame:
    """Submissions that often come without an address: all of these count as one."""
    unknown = F.when(F.col("submission_id").cast("long") % 3 > 0, F.col("client_ip"))
    return alerts.burst_windows(alerts.activity(t.submissions().withColumn("client_ip", unknown)), RULES)


# streams, run to the end of the given events and read back ----------------------------


def _stream(t: DriverTables) -> tuple[DriverTables, Settings]:
    width = t.spark.sparkContext.defaultParallelism
    settings = Settings(root=new_folder(t.spark, "stream"), stream_shuffle_partitions=width, count_state_rows=False)
    return DriverTables(stream_session(t.spark, settings), t.folder), settings


@query
def stream_bronze(t: DriverTables) -> DataFrame:
    live, settings = _stream(t)
    messages = live.submission_messages(live.event_stream())
    streams.start_bronze_submissions(messages, settings, available_now=True).awaitTermination()
    return batch.silver_submissions(Warehouse(t.spark, settings.root).read_bronze("bronze_submissions"))


@query
def stream_bronze_metrics(t: DriverTables) -> DataFrame:
    live, settings = _stream(t)
    messages = live.metric_messages(live.event_stream())
    streams.start_bronze_metrics(messages, settings, available_now=True).awaitTermination()
    stored = batch.silver_metrics(Warehouse(t.spark, settings.root).read_bronze("bronze_metrics"))
    return stored.drop("day")


@query
def stream_leaderboard(t: DriverTables) -> DataFrame:
    live, settings = _stream(t)
    messages = live.submission_messages(live.event_stream())
    streams.start_leaderboard(messages, settings, available_now=True).awaitTermination()
    current = Warehouse(t.spark, settings.root).read_current("gold_live_leaderboard")
    return current.drop("last_updated")


@query
def stream_alerts(t: DriverTables) -> DataFrame:
    live, settings = _stream(t)
    streams.start_alerts(
        live.submission_messages(live.event_stream()),
        live.metric_messages(live.event_stream()),
        settings,
        available_now=True,
    ).awaitTermination()
    return Warehouse(t.spark, settings.root).read_alerts().select(*alerts.ALERT_COLUMNS)


@query
def stream_alerts_once_a_minute(t: DriverTables) -> DataFrame:
    """Burst alerts of a stream that raises one per user and minute."""
    live, settings = _stream(t)
    streams.start_alerts(
        live.submission_messages(live.event_stream()),
        live.metric_messages(live.event_stream()),
        replace(settings, alert_once_a_minute=True),
        available_now=True,
    ).awaitTermination()
    found = Warehouse(t.spark, settings.root).read_alerts()
    return found.filter(F.col("alert_type") == "CHEAT_DETECTED").select(*alerts.ALERT_COLUMNS)


@query
def stream_cheat_alerts_approx(t: DriverTables) -> DataFrame:
    """Burst alerts of a stream that counts addresses with sketches."""
    live, settings = _stream(t)
    streams.start_alerts(
        live.submission_messages(live.event_stream()),
        live.metric_messages(live.event_stream()),
        replace(settings, approximate_addresses=True),
        available_now=True,
    ).awaitTermination()
    return Warehouse(t.spark, settings.root).read_alerts().select(*alerts.ALERT_COLUMNS)


@query
def stream_from_topic_files(t: DriverTables) -> DataFrame:
    """Topics as folders of message files, taken one file a batch by all four streams; the typed submissions."""
    topics, width = new_folder(t.spark, "topics"), t.spark.sparkContext.defaultParallelism
    settings = Settings(
        root=new_folder(t.spark, "stream"),
        source_kind="files",
        source_path=topics,
        max_files_per_trigger=1,
        stream_shuffle_partitions=width,
        compact_every=2,
    )
    for topic, messages in (
        (settings.submissions_topic, t.submission_messages()),
        (settings.metrics_topic, t.metric_messages()),
    ):
        payloads.decode(messages).coalesce(3).write.text(f"{topics}/{topic}")
    for running in streams.start_all(stream_session(t.spark, settings), settings, available_now=True):
        running.awaitTermination()
    return batch.silver_submissions(Warehouse(t.spark, settings.root).read_bronze("bronze_submissions"))


def _arrive(events: DataFrame, arrivals: DriverTables) -> None:
    """Store events that came together, dealt evenly to files: a part of the time lies in few splits of the table."""
    width = events.sparkSession.sparkContext.defaultParallelism
    events.repartition(width).write.mode("append").parquet(arrivals.path("events"))


def _in_four_runs(t: DriverTables, start: Callable[[DriverTables, Settings], StreamingQuery]) -> Warehouse:
    """The events in order of time, in four parts; the stream ends after each and starts again."""
    live, settings = _stream(t)
    settings = replace(settings, compact_every=2)
    events, folder = t.table("events"), new_folder(t.spark, "arrivals")
    edges = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.01)
    part = sum(((F.col("event_id") > edge).cast("int") for edge in edges), F.lit(0))
    arrivals = DriverTables(live.spark, folder)
    for number in range(len(edges) + 1):
        _arrive(events.filter(part == number), arrivals)
        start(arrivals, settings).awaitTermination()
    return Warehouse(t.spark, settings.root)


@query
def restarted_leaderboard(t: DriverTables) -> DataFrame:
    def start(live: DriverTables, settings: Settings) -> StreamingQuery:
        messages = live.submission_messages(live.event_stream())
        return streams.start_leaderboard(messages, settings, available_now=True)

    return _in_four_runs(t, start).read_current("gold_live_leaderboard").drop("last_updated")


@query
def restarted_alerts(t: DriverTables) -> DataFrame:
    def start(live: DriverTables, settings: Settings) -> StreamingQuery:
        return streams.start_alerts(
            live.submission_messages(live.event_stream()),
            live.metric_messages(live.event_stream()),
            settings,
            available_now=True,
        )

    return _in_four_runs(t, start).read_alerts().select(*alerts.ALERT_COLUMNS)


def _part_of(t: DriverTables) -> Column:
    """Which of four arrivals an event is in: three of the order of time, and last what is late of the first."""
    events = t.table("events")
    bounds = events.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    place = (F.col("event_id") - F.lit(bounds["a"])) * 4 / F.lit(bounds["b"] - bounds["a"] + 1)
    late = (place < 1) & (F.col("event_id") % 5 < 3)
    return F.when(late, 3).when(place < 2, 0).when(place < 3, 1).otherwise(2)


@query
def late_alerts(t: DriverTables) -> DataFrame:
    """What the night adds to the alerts of a stream that most events of the first quarter reached last."""
    live, settings = _stream(t)
    events, part, folder = t.table("events"), _part_of(t), new_folder(t.spark, "arrivals")
    arrivals = DriverTables(live.spark, folder)
    for number in range(4):
        _arrive(events.filter(part == number), arrivals)
        for running in (
            streams.start_bronze_submissions(arrivals.submission_messages(arrivals.event_stream()), settings, True),
            streams.start_alerts(
                arrivals.submission_messages(arrivals.event_stream()),
                arrivals.metric_messages(arrivals.event_stream()),
                settings,
                available_now=True,
            ),
        ):
            running.awaitTermination()
    return batch.late_alerts(Warehouse(t.spark, settings.root), RULES)


@query
def fresh_start_counts(t: DriverTables) -> DataFrame:
    """Rows after the streams took all events, began afresh and took them again."""
    live, settings = _stream(t)
    warehouse = Warehouse(t.spark, settings.root)
    for again in (False, True):
        if again:
            warehouse.open_generation()
        for running in (
            streams.start_bronze_submissions(live.submission_messages(live.event_stream()), settings, True),
            streams.start_leaderboard(live.submission_messages(live.event_stream()), settings, True),
        ):
            running.awaitTermination()
    return warehouse.row_counts(["bronze_submissions", "gold_live_leaderboard", "gold_system_alerts"])


@query
def alerts_without_a_time(t: DriverTables) -> DataFrame:
    """Latency alerts of a stream whose metrics do not say when: all of them have a time."""
    live, settings = _stream(t)
    metrics = live.metric_messages(live.event_stream())
    silent = metrics.select(
        F.regexp_replace(F.col("value").cast("string"), ',"timestamp":[^,}]*', "").cast("binary").alias("value")
    )
    streams.start_alerts(live.submission_messages(live.event_stream()), silent, settings, True).awaitTermination()
    found = Warehouse(t.spark, settings.root).read_alerts().filter(F.col("alert_type") == "HIGH_LATENCY")
    return found.agg(F.count("*").alias("rows"), F.count("triggered_at").alias("timed"))


# the nightly job, run whole -----------------------------------------------------------


def _nightly(t: DriverTables) -> Warehouse:
    settings = Settings(root=new_folder(t.spark, "nightly"))
    warehouse = Warehouse(t.spark, settings.root)
    # a file of one row group is one task's read; its events are dealt out before they are parsed
    events = t.table("events").repartition("event_id", "ts", "user_id")
    for name, schema, messages in (
        ("bronze_submissions", schemas.SUBMISSION, t.submission_messages(events)),
        ("bronze_metrics", schemas.METRIC, t.metric_messages(events)),
    ):
        raw = payloads.decode(messages)
        warehouse.append_bronze(payloads.bronze(raw, schema, schemas.BRONZE_KEYS[name]), name)
    metadata = {"problems": t.taught_problems(), "ratings": t.ratings(), "transactions": t.transactions()}
    batch.run_batch(t.spark, settings, metadata)
    return warehouse


@query
def nightly_table_counts(t: DriverTables) -> DataFrame:
    """Rows in each table the nightly job wrote."""
    return _once(t, _nightly).row_counts(["bronze_submissions", "silver_submissions", *schemas.BATCH_GOLD])


_WAREHOUSES: dict[tuple, Warehouse] = {}


def _once(t: DriverTables, build: Callable[[DriverTables], Warehouse]) -> Warehouse:
    """The tables of one job per application and state of the files, for the queries that read them back."""
    key = (t.spark.sparkContext.applicationId, build.__name__, t.folder, t.state())
    if key not in _WAREHOUSES:
        _WAREHOUSES[key] = build(t)
    return _WAREHOUSES[key]


def _stored(t: DriverTables, name: str) -> DataFrame:
    return _once(t, _nightly).read(name).drop("last_updated")


@query
def nightly_engagement_scores(t: DriverTables) -> DataFrame:
    return _stored(t, "gold_engagement_scores")


@query
def nightly_difficulty_heatmap(t: DriverTables) -> DataFrame:
    return _stored(t, "gold_difficulty_heatmap")


@query
def nightly_subscription_revenue(t: DriverTables) -> DataFrame:
    return _stored(t, "gold_subscription_revenue")


@query
def nightly_instructor_report_card(t: DriverTables) -> DataFrame:
    return _stored(t, "gold_instructor_report_card")


@query
def nightly_adaptive_profiles(t: DriverTables) -> DataFrame:
    return _stored(t, "gold_adaptive_difficulty_profiles")


def _boards(t: DriverTables) -> Boards:
    return Boards(_once(t, _nightly), t.users(), t.problems())


@query
def stored_heatmap_board(t: DriverTables) -> DataFrame:
    return _boards(t).heatmap().drop("last_updated")


@query
def stored_failure_rollup(t: DriverTables) -> DataFrame:
    return _boards(t).failure_rollup()


@query
def stored_instructor_board(t: DriverTables) -> DataFrame:
    return _boards(t).instructors().drop("last_updated")


@query
def stored_tier_distribution(t: DriverTables) -> DataFrame:
    return _boards(t).tier_distribution()


@query
def stored_failure_share(t: DriverTables) -> DataFrame:
    return _boards(t).failure_share()


@query
def stored_risk_board(t: DriverTables) -> DataFrame:
    return _boards(t).risk().drop("last_updated")


@query
def stored_revenue_board(t: DriverTables) -> DataFrame:
    return _boards(t).revenue().drop("last_updated")


@query
def stored_revenue_totals(t: DriverTables) -> DataFrame:
    return _boards(t).revenue_totals()


@query
def stored_update_times(t: DriverTables) -> DataFrame:
    """Rows of each report, and how many of them say when they were stored."""
    warehouse = _once(t, _nightly)
    counted = [
        warehouse.read(name, ["last_updated"]).agg(F.count("*").alias("rows"), F.count("last_updated").alias("stamped"))
        .select(F.lit(name).alias("table_name"), "rows", "stamped")
        for name in schemas.BATCH_GOLD
    ]
    return reduce(DataFrame.unionByName, counted)


def _live(t: DriverTables) -> Warehouse:
    """The tables of the night, and of streams that took all events: they write tables of their own beside them."""
    warehouse = _once(t, _nightly)
    width = t.spark.sparkContext.defaultParallelism
    settings = Settings(root=warehouse.root, stream_shuffle_partitions=width, count_state_rows=False)
    live = DriverTables(stream_session(t.spark, settings), t.folder)
    for running in (
        streams.start_leaderboard(live.submission_messages(live.event_stream()), settings, available_now=True),
        streams.start_alerts(
            live.submission_messages(live.event_stream()),
            live.metric_messages(live.event_stream()),
            settings,
            available_now=True,
        ),
    ):
        running.awaitTermination()
    return warehouse


def _live_boards(t: DriverTables) -> Boards:
    return Boards(_once(t, _live), t.users(), t.problems())


@query
def stored_leaderboard(t: DriverTables) -> DataFrame:
    return _live_boards(t).leaderboard().drop("last_updated")


@query
def stored_leaderboard_kpis(t: DriverTables) -> DataFrame:
    return _live_boards(t).leaderboard_kpis()


@query
def stored_quick_stats(t: DriverTables) -> DataFrame:
    return _live_boards(t).quick_stats()


@query
def stored_alert_feed(t: DriverTables) -> DataFrame:
    return _live_boards(t).alerts()


@query
def stored_alert_counts(t: DriverTables) -> DataFrame:
    return _live_boards(t).alert_counts()


_NIGHTS = ("2024-02-01", "2024-02-02", "2024-02-03")


def _three_nights(t: DriverTables) -> Warehouse:
    """All messages over three nights, the first rebuilt whole and the others added by their day.

    What comes on the second and third night came before, with another event time or user: the
    later copy must leave nothing of the earlier one behind.
    """
    warehouse = Warehouse(t.spark, new_folder(t.spark, "nights"))
    for name, schema, messages in (
        ("bronze_submissions", schemas.SUBMISSION, t.submission_messages()),
        ("bronze_metrics", schemas.METRIC, t.metric_messages()),
    ):
        key = schemas.BRONZE_KEYS[name]
        rows = payloads.bronze(payloads.decode(messages), schema, key)
        night = F.pmod(F.xxhash64(key), F.lit(len(_NIGHTS)))
        moved = F.regexp_replace("raw_payload", '"timestamp":', '"timestamp":1')
        renamed = F.regexp_replace("raw_payload", '"user_id":"', '"user_id":"other_')
        earlier = F.when(night == 1, moved).otherwise(renamed)
        for number, day in enumerate(_NIGHTS):
            came = rows.filter(night == number)
            if number == 0:
                came = came.unionByName(rows.filter(night > 0).withColumn("raw_payload", earlier))
            at = F.lit(day).cast("timestamp")
            warehouse.append_bronze(
                came.withColumns({"ingest_timestamp": at, "ingest_day": at.cast("date")}), name
            )
    batch.refresh(warehouse, _NIGHTS[:1])
    for day in _NIGHTS[1:]:
        batch.refresh(warehouse, [day])
    return warehouse


@query
def incremental_submissions(t: DriverTables) -> DataFrame:
    return _once(t, _three_nights).read("silver_submissions")


@query
def incremental_metrics(t: DriverTables) -> DataFrame:
    return _once(t, _three_nights).read("silver_metrics").drop("day")


@query
def incremental_features(t: DriverTables) -> DataFrame:
    warehouse = _once(t, _three_nights)
    login = features.login_minutes(warehouse.read("login_totals"))
    return features.user_features(warehouse.read("attempt_totals"), login)


# checks around the models, which SQL cannot fit ---------------------------------------


@query
def dropout_prediction_checks(t: DriverTables) -> DataFrame:
    """Users scored, and the scores that break a rule."""
    scored = _predictions(t)
    p, band = F.col("dropout_probability"), F.col("risk_label")
    fits = ((band == "HIGH") & (p >= RULES.risk_high)) | (
        (band == "MEDIUM") & (p >= RULES.risk_medium) & (p < RULES.risk_high)
    ) | ((band == "LOW") & (p < RULES.risk_medium))
    return scored.agg(
        F.count("*").alias("users"),
        F.count_if(p.isNull() | ~p.between(0, 1)).alias("no_probability"),
        F.count_if(~F.coalesce(fits, F.lit(False))).alias("wrong_band"),
    )


@query
def recommendation_checks(t: DriverTables) -> DataFrame:
    """Users who got a recommendation, and those that break a rule."""
    got = _recommendations(t)
    tried = t.submissions().select("problem_id").distinct().withColumn("known", F.lit(True))
    score = F.col("recommendation_score")
    return (
        got.join(tried, got["recommended_problem_id"] == tried["problem_id"], "left")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("user_id").alias("users"),
            F.count_if(F.col("known").isNull()).alias("unknown_problems"),
            F.count_if(score.isNull() | (F.round(score, 4) != score)).alias("unrounded"),
        )
    )


@query
def dropout_model_weights(t: DriverTables) -> DataFrame:
    """What the regression learned, and the gradient of its loss there."""
    found = dropout.weights(staged(_features(t), "features"), RULES, LEARNING)
    # adding zero makes no difference between -0.0 and 0.0
    rounded = [(F.round(name, digits) + 0.0).alias(name) for name, digits in (("weight", 4), ("gradient", 3))]
    return found.select("term", *rounded)


@query
def dropout_predictions_rounded(t: DriverTables) -> DataFrame:
    """The fitted probabilities to three places."""
    return _predictions(t).select(
        "user_id", F.round("dropout_probability", 3).alias("dropout_probability"), "risk_label"
    )


def _factors(t: DriverTables) -> recommend.Factors:
    return recommend.fitted(staged(gold.interactions(features.attempts(t.submissions())), "interactions"), LEARNING)


@query
def recommendation_factor_checks(t: DriverTables) -> DataFrame:
    """Factors of users and problems, and users whose factors are not the optimum for the problems'."""
    factors = _factors(t)
    parts = [
        factors.model.userFactors.select(F.lit("users").alias("what")),
        factors.model.itemFactors.select(F.lit("problems").alias("what")),
        recommend.unbalanced_users(factors, LEARNING).select(F.lit("users off the optimum").alias("what")),
    ]
    counted = [part.agg(F.max("what").alias("w"), F.count("*").alias("rows")) for part in parts]
    names = "users", "problems", "users off the optimum"
    named = [part.select(F.lit(name).alias("what"), "rows") for part, name in zip(counted, names, strict=True)]
    return reduce(DataFrame.unionByName, named)


@query
def unsolved_recommendation_checks(t: DriverTables) -> DataFrame:
    """Recommendations of unsolved problems alone: who got one, and how many of them were solved before."""
    passes = staged(gold.interactions(features.attempts(t.submissions())), "interactions")
    got = recommend.next_problem(passes, replace(LEARNING, exclude_solved=True))
    solved = passes.select("user_id", "problem_id", F.lit(True).alias("solved"))
    same = (got["user_id"] == solved["user_id"]) & (got["recommended_problem_id"] == solved["problem_id"])
    return got.join(solved, same, "left").agg(
        F.count("*").alias("rows"),
        F.count_distinct(got["user_id"]).alias("users"),
        F.count("solved").alias("solved_before"),
    )


@query
def key_number_checks(t: DriverTables) -> DataFrame:
    """Numbers of users and problems: a number for each key, none twice, none too large."""

    def checked(keys: DataFrame, key: str) -> DataFrame:
        numbers = numbering.numbered(keys, key, "number", LEARNING.id_buckets)
        in_bucket = F.col("number") % LEARNING.id_buckets == F.pmod(F.xxhash64(key), F.lit(LEARNING.id_buckets))
        return numbers.agg(
            F.count("*").alias("keys"),
            F.count_distinct("number").alias("numbers"),
            F.count_if(~in_bucket | (F.col("number") < 0)).alias("misplaced"),
        ).withColumn("what", F.lit(key))

    submissions = t.submissions()
    return checked(submissions, "user_id").unionByName(checked(submissions, "problem_id"))


# boards -------------------------------------------------------------------------------


@query
def srv_risk_board_by_rate(t: DriverTables) -> DataFrame:
    """The risk board over a score that SQL can state: the share of failed submissions."""
    users = _features(t)
    scored = users.select("user_id", (F.col("fail_rate_pct") / 100).alias("dropout_probability"))
    return serving.risk_board(dropout.banded(scored, RULES), t.users(), gold.adaptive_profiles(users, RULES))


@query
def srv_recommendation_board_by_passes(t: DriverTables) -> DataFrame:
    """The recommendation board over a choice that SQL can state: the problem passed most often."""
    passes = gold.interactions(features.attempts(t.submissions()))
    chosen = passes.groupBy("user_id").agg(
        F.max(F.struct("rating", F.col("problem_id").alias("recommended_problem_id"))).alias("best")
    )
    chosen = chosen.select(
        "user_id", "best.recommended_problem_id", F.col("best.rating").cast("double").alias("recommendation_score")
    )
    profiles = gold.adaptive_profiles(_features(t), RULES)
    return serving.recommendation_board(chosen, t.users(), t.problems(), profiles)



@query
def srv_leaderboard_top10(t: DriverTables) -> DataFrame:
    return serving.leaderboard(leaderboard.solved_counts(t.submissions()), t.users())


@query
def srv_leaderboard_kpis(t: DriverTables) -> DataFrame:
    return serving.leaderboard_kpis(leaderboard.solved_counts(t.submissions()), t.users())


@query
def srv_leaderboard_age(t: DriverTables) -> DataFrame:
    """The leaderboard with the age of each user's last pass at a fixed moment."""
    passes = t.submissions().filter(F.col("status") == "Pass")
    last = passes.groupBy("user_id").agg(F.max("timestamp").alias("last_updated"))
    board = leaderboard.solved_counts(t.submissions()).join(last, "user_id")
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    return serving.leaderboard(board, t.users(), as_of=as_of)


@query
def srv_quick_stats(t: DriverTables) -> DataFrame:
    return serving.status_line(t.submissions(), t.metrics(), RULES)


@query
def srv_heatmap_top12(t: DriverTables) -> DataFrame:
    return serving.heatmap(_heatmap(t), t.problems())


@query
def srv_failure_rollup(t: DriverTables) -> DataFrame:
    return serving.failure_rollup(_heatmap(t), t.problems())


@query
def srv_failure_share(t: DriverTables) -> DataFrame:
    return serving.failure_share(_heatmap(t))


@query
def srv_revenue(t: DriverTables) -> DataFrame:
    return serving.revenue(gold.subscription_revenue(t.transactions()))


@query
def srv_revenue_totals(t: DriverTables) -> DataFrame:
    return serving.revenue_totals(gold.subscription_revenue(t.transactions()))


@query
def srv_instructors(t: DriverTables) -> DataFrame:
    return serving.instructors(gold.instructor_report(t.ratings(), t.taught_problems()))


@query
def srv_risk_board(t: DriverTables) -> DataFrame:
    users = staged(_features(t), "features")
    scored = dropout.predictions(users, RULES, LEARNING)
    return serving.risk_board(scored, t.users(), gold.adaptive_profiles(users, RULES))


@query
def srv_recommendation_board(t: DriverTables) -> DataFrame:
    profiles = gold.adaptive_profiles(_features(t), RULES)
    return serving.recommendation_board(_recommendations(t), t.users(), t.problems(), profiles)


@query
def srv_tier_distribution(t: DriverTables) -> DataFrame:
    attempts = features.attempts(t.submissions())
    recommended = gold.interactions(attempts).select("user_id").distinct()  # whoever passed gets one
    return serving.tier_distribution(recommended, gold.adaptive_profiles(_features(t), RULES))


@query
def srv_alert_feed(t: DriverTables) -> DataFrame:
    return serving.alert_feed(_alerts(t), t.users())


@query
def srv_alert_counts(t: DriverTables) -> DataFrame:
    return serving.alert_counts(_alerts(t))


@query
def relative_age(t: DriverTables) -> DataFrame:
    """Age of every event as of a fixed moment."""
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return t.table("events").select(
        F.col("event_id").cast("string").alias("submission_id"),
        times.relative_age(F.col("ts").cast("timestamp"), as_of).alias("age"),
    )
