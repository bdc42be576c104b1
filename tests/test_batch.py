import json
from dataclasses import replace
from pathlib import Path

import pytest
from compare import connect, difference
from conftest import SMALL
from pyspark.sql import functions as F

from learnlens import schemas
from learnlens.config import Settings
from learnlens.plans import batch, catalogue, oracle
from learnlens.plans.boards import Boards
from learnlens.session import shared_dir
from learnlens.sources import payloads
from learnlens.sources.driver_tables import DriverTables
from learnlens.sources.tables import Warehouse


def load(spark, warehouse, name, schema, raw):
    key = schemas.BRONZE_KEYS[name]
    warehouse.append_bronze(payloads.bronze(raw, schema, key), name)


@pytest.fixture(scope="module")
def nightly(spark):
    """The nightly job over the smallest tables."""
    return catalogue._nightly(DriverTables(spark, SMALL))


@pytest.mark.parametrize(
    ("table", "query"),
    [
        ("silver_submissions", "silver_submissions"),
        ("attempt_totals", "attempt_totals"),
        ("user_features", "user_features"),
        ("gold_engagement_scores", "engagement_scores"),
        ("gold_difficulty_heatmap", "difficulty_heatmap"),
        ("gold_subscription_revenue", "subscription_revenue"),
        ("gold_instructor_report_card", "instructor_report_card"),
        ("gold_adaptive_difficulty_profiles", "adaptive_profiles"),
        ("gold_dropout_predictions", "dropout_constant_fallback"),
    ],
)
def test_stored_tables_equal_the_sql(nightly, table, query):
    df = nightly.read(table).drop("last_updated")
    assert difference(df, oracle.statements()[query], connect(SMALL)) is None


def test_stored_metrics_equal_the_sql(nightly):
    df = nightly.read("silver_metrics").drop("day")
    assert difference(df, oracle.statements()["silver_metrics"], connect(SMALL)) is None


def test_streams_write_beside_the_tables_of_the_night(spark):
    t = DriverTables(spark, SMALL)
    night, live = catalogue._once(t, catalogue._nightly), catalogue._once(t, catalogue._live)
    assert live.root == night.root  # the night is not run a second time
    assert not live.read_current("gold_live_leaderboard").isEmpty() and not live.read_alerts().isEmpty()
    versions = {name: night.versions(name) for name in schemas.BATCH_GOLD}
    assert all(len(found) == 1 for found in versions.values())


def test_recommendations_are_stored_once_per_user(nightly):
    rows = nightly.read("gold_next_problem_recommendations").collect()
    assert len({r.user_id for r in rows}) == len(rows) > 0
    assert all(r.last_updated for r in rows)


def test_boards_over_the_stored_tables(spark, nightly):
    t = DriverTables(spark, SMALL)
    boards, sql, duck = Boards(nightly, t.users(), t.problems()), oracle.statements(), connect(SMALL)

    def without_stamp(df):
        return df.drop("last_updated")

    for df, query in (
        (boards.heatmap(), "srv_heatmap_top12"),
        (boards.failure_rollup(), "srv_failure_rollup"),
        (boards.failure_share(), "srv_failure_share"),
        (boards.revenue(), "srv_revenue"),
        (boards.revenue_totals(), "srv_revenue_totals"),
        (boards.instructors(), "srv_instructors"),
        (boards.tier_distribution(), "srv_tier_distribution"),
    ):
        assert difference(without_stamp(df), sql[query], duck) is None
    users = nightly.read("user_features").count()
    assert boards.risk().count() == users
    assert boards.risk(limit=3).count() == 3
    assert boards.recommendations().count() == nightly.read("gold_next_problem_recommendations").count()
    # no stream has run here
    assert boards.leaderboard().isEmpty() and boards.alerts().isEmpty()
    assert tuple(boards.alert_counts().first()) == (0, 0)
    assert tuple(boards.leaderboard_kpis().first()) == (None, 0, 0)
    assert boards.quick_stats().first().active_users == 0


def submission(number, user="u", problem="p", status="Pass", epoch=1704067200.0, ms=5):
    return json.dumps(
        {
            "submission_id": f"s{number}",
            "user_id": user,
            "problem_id": problem,
            "status": status,
            "execution_time_ms": ms,
            "timestamp": epoch,
        }
    )


def raw(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "raw_payload string")


def scores(warehouse):
    return {r.user_id: r.engagement_score for r in warehouse.read("gold_engagement_scores").collect()}


def test_replays_and_corrections_count_once(spark, root):
    settings, warehouse = Settings(root=root), Warehouse(spark, root)
    first = raw(spark, submission(1), submission(1), submission(2, status="Wrong Answer"), "junk")
    load(spark, warehouse, "bronze_submissions", schemas.SUBMISSION, first)
    shared = Path(shared_dir(spark).removeprefix("file:"), "learnlens")
    there = set(shared.glob("*"))
    written = batch.run_batch(spark, settings, {})  # no metadata
    assert set(shared.glob("*")) == there  # what was staged is gone
    assert "gold_instructor_report_card" not in written
    heat = warehouse.read("gold_difficulty_heatmap").drop("last_updated").collect()
    assert [(r.problem_id, r.total_attempts, r.failed_attempts, r.category) for r in heat] == [("p", 2, 1, None)]
    assert scores(warehouse) == {"u": 18}

    load(spark, warehouse, "bronze_submissions", schemas.SUBMISSION, raw(spark, submission(2), submission(1)))
    batch.run_batch(spark, settings, {})
    assert scores(warehouse) == {"u": 36}
    assert warehouse.read("silver_submissions").count() == 2


def test_reset_or_merge(spark, root):
    settings, warehouse = Settings(root=root), Warehouse(spark, root)
    old = spark.createDataFrame([("gone", 7, None), ("u", 1, None)], schemas.TABLES["gold_engagement_scores"])
    warehouse.write_snapshot(old, "gold_engagement_scores")
    load(spark, warehouse, "bronze_submissions", schemas.SUBMISSION, raw(spark, submission(1)))
    batch.run_batch(spark, replace(settings, reset_gold=False), {})
    assert scores(warehouse) == {"gone": 7, "u": 18}
    batch.run_batch(spark, settings, {})
    assert scores(warehouse) == {"u": 18}


def test_nothing_to_do(spark, root):
    written = batch.run_batch(spark, Settings(root=root), {"problems": spark.createDataFrame([], "problem_id string")})
    assert "gold_next_problem_recommendations" not in written
    assert Warehouse(spark, root).read("user_features").isEmpty()


def metric(number, value, epoch=1704067200.0, user="u"):
    return json.dumps(
        {
            "metric_id": f"m{number}",
            "user_id": user,
            "metric_type": "submission_interval_sec",
            "value": value,
            "timestamp": epoch,
        }
    )


def test_the_last_copy_of_a_metric_decides(spark, root):
    warehouse = Warehouse(spark, root)
    load(spark, warehouse, "bronze_metrics", schemas.METRIC, raw(spark, metric(1, 60), metric(2, 60)))
    load(spark, warehouse, "bronze_metrics", schemas.METRIC, raw(spark, metric(1, 120), metric(2, 60, user=None)))
    batch.run_batch(spark, Settings(root=root), {})
    assert [(r.metric_id, r.value) for r in warehouse.read("silver_metrics").collect()] == [("m1", 120.0)]
    assert [(r.user_id, r.seconds) for r in warehouse.read("login_totals").collect()] == [("u", 120.0)]


def test_a_night_over_the_days_that_came_equals_a_full_rebuild(spark, root):
    settings, warehouse, day = Settings(root=root), Warehouse(spark, root), 86400
    start = 1704067200.0

    def deliver(submissions, metrics):
        load(spark, warehouse, "bronze_submissions", schemas.SUBMISSION, raw(spark, *submissions))
        load(spark, warehouse, "bronze_metrics", schemas.METRIC, raw(spark, *metrics))

    deliver(
        [submission(i, user=f"u{i % 2}", epoch=start + (i % 3) * day) for i in range(9)]
        + [submission(90, epoch=None), submission(91, epoch=1e18)],
        [metric(i, 30 + i, epoch=start + (i % 3) * day) for i in range(6)],
    )
    batch.run_batch(spark, settings, {})
    today = str(warehouse.read_bronze("bronze_submissions").first().ingest_day)
    deliver(
        [
            submission(2, user="u0", status="Runtime Error", epoch=start + 2 * day),
            submission(20, epoch=start),
            submission(92, epoch=None),
        ],
        [metric(0, 30, epoch=start), metric(7, 5, epoch=start + day)],
    )

    def tables():
        names = ["silver_submissions", "silver_metrics", "attempt_totals", "login_totals", "user_features"]
        frames = {name: warehouse.read(name) for name in [*names, "gold_engagement_scores"]}
        return {n: sorted(map(str, df.drop("last_updated").collect())) for n, df in frames.items()}

    before = tables()
    batch.run_batch(spark, settings, {}, ingest_days=["1999-01-01"])  # nothing came
    assert tables() == before
    batch.run_batch(spark, settings, {}, ingest_days=[today])
    partial = tables()
    batch.run_batch(spark, settings, {})
    assert partial == tables() != before
    assert len(partial["silver_submissions"]) == 13


DAY, START = 86400, 1704067200.0


def deliver_on(warehouse, name, schema, day, *texts):
    key = schemas.BRONZE_KEYS[name]
    rows = payloads.bronze(raw(warehouse.spark, *texts), schema, key)
    at = F.lit(day).cast("timestamp")
    warehouse.append_bronze(rows.withColumns({"ingest_timestamp": at, "ingest_day": at.cast("date")}), name)


def typed_tables(warehouse):
    return {n: sorted(map(str, warehouse.read(n).collect())) for n in schemas.BY_DAY}


@pytest.fixture()
def changed(spark, root):
    """A replay that loses its user, and a replay that moves to another event day."""
    warehouse = Warehouse(spark, root)
    deliver_on(
        warehouse, "bronze_submissions", schemas.SUBMISSION, "2024-02-01",
        submission(1, epoch=START), submission(2, epoch=START + DAY),
    )
    deliver_on(warehouse, "bronze_metrics", schemas.METRIC, "2024-02-01", metric(1, 60), metric(2, 60))
    batch.refresh(warehouse, ["2024-02-01"])
    deliver_on(warehouse, "bronze_submissions", schemas.SUBMISSION, "2024-02-02", submission(1, epoch=START + 5 * DAY))
    deliver_on(warehouse, "bronze_metrics", schemas.METRIC, "2024-02-02", metric(2, 60, user=None))
    return warehouse


def test_a_night_leaves_nothing_of_earlier_copies(changed):
    batch.refresh(changed, ["2024-02-02"])
    night = typed_tables(changed)
    assert [str(r.day) for r in changed.read("silver_submissions").orderBy("day").collect()] == [
        "2024-01-02",
        "2024-01-06",  # the day it came from is empty and gone
    ]
    assert [r.seconds for r in changed.read("login_totals").collect()] == [60.0]
    batch.refresh(changed)
    assert typed_tables(changed) == night


def test_a_night_cut_between_two_writes_changes_nothing(changed, monkeypatch):
    before = typed_tables(changed)

    def fails(_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(batch, "attempt_totals", fails)
        with pytest.raises(RuntimeError, match="lost"):
            batch.refresh(changed, ["2024-02-02"])
    assert typed_tables(changed) == before
    batch.refresh(changed, ["2024-02-02"])
    night = typed_tables(changed)
    for name in schemas.BY_DAY:
        changed.expire(name, keep=1)
    assert typed_tables(changed) == night
    batch.refresh(changed)
    assert typed_tables(changed) == night != before
