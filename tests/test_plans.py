"""Physical plans: what must be there and what must not."""

import pytest
from conftest import SMALL

from learnlens import schemas
from learnlens.config import Settings
from learnlens.plans import batch, catalogue
from learnlens.session import shared_dir
from learnlens.sources import payloads
from learnlens.sources.tables import Warehouse

QUERIES = catalogue.registered()
RUN_JOBS = {  # these train or run streams while they are built
    "alerts_without_a_time",
    "fresh_start_counts",
    "late_alerts",
    "dropout_model_weights",
    "dropout_predictions",
    "dropout_predictions_rounded",
    "next_problem_recommendations",
    "nightly_table_counts",
    "recommendation_checks",
    "recommendation_factor_checks",
    "unsolved_recommendation_checks",
    "restarted_alerts",
    "restarted_leaderboard",
    "srv_risk_board",
    "srv_recommendation_board",
    "stream_alerts",
    "stream_alerts_once_a_minute",
    "stream_cheat_alerts_approx",
    "stream_from_topic_files",
    "stream_bronze",
    "stream_bronze_metrics",
    "stream_leaderboard",
}


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUN_JOBS))
def test_no_python_and_no_products(spark, name):
    text = plan(spark, name)
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


@pytest.mark.parametrize("name", ["srv_leaderboard_top10", "srv_heatmap_top12", "srv_alert_feed"])
def test_top_k_is_not_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan(spark, "cheat_windows")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan(spark, "login_minutes")
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in plan(spark, "subscription_revenue")
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan(spark, "cohort_leaderboard")


def test_the_status_line_reads_each_table_once(spark):
    text = plan(spark, "srv_quick_stats")
    assert text.count("ReadSchema") == 2 and "Join" not in text and text.count("Exchange") == 2


def test_failure_share_reads_its_tables_once(spark):
    assert plan(spark, "srv_failure_share").count("ReadSchema") == 2


def test_small_metadata_is_broadcast_by_its_size_not_by_a_hint(spark):
    assert "BroadcastHashJoin" in plan(spark, "difficulty_heatmap")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(spark, "difficulty_heatmap")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["silver_submissions", "silver_metrics", "quarantined_payloads"])
def test_payloads_are_parsed_once(spark, name):
    assert plan(spark, name).count("from_json(") == 1


def test_the_typed_tables_parse_once(spark, root):
    raw = Warehouse(spark, root)
    message = spark.createDataFrame([('{"submission_id": "s", "metric_id": "m"}',)], "raw_payload string")
    for name, schema, typed in (
        ("bronze_submissions", schemas.SUBMISSION, batch.silver_submissions),
        ("bronze_metrics", schemas.METRIC, batch.silver_metrics),
    ):
        raw.append_bronze(payloads.bronze(message, schema, schemas.BRONZE_KEYS[name]), name)
        text = typed(raw.read_bronze(name))._jdf.queryExecution().executedPlan().toString()
        assert text.count("from_json(") == 1
        assert "accepted#" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_daily_tables_are_rebalanced_by_day(spark, root):
    df = spark.createDataFrame([], schemas.TABLES["silver_submissions"])
    text = Warehouse(spark, root)._laid_out(df.repartition(3), "silver_submissions")
    text = text._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in text
    assert "Sort [day" in text and "timestamp#" in text.split("Sort [day")[1].split("]")[0]


def test_address_counts_shuffle_numbers_only(spark):
    text = plan(spark, "cheat_windows")
    assert text.count("Exchange") == 2 and "SortAggregate" not in text and "ObjectHash" not in text


def test_ratings_are_summed_before_the_join(spark):
    text = plan(spark, "instructor_report_card")
    assert text.index("Join") < text.index("partial_sum(rating_score")


def test_copies_of_a_key_are_reduced_before_the_shuffle(spark):
    text = plan(spark, "latest_by_key")
    shuffled = text.index("Exchange hashpartitioning(l_orderkey")
    assert "row_number(), 1, Partial" in text[shuffled:] and "row_number(), 1, Final" in text[:shuffled]
    assert "SortAggregate" not in text


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    else:
        assert shared_dir(spark)


def test_settings_from_env():
    env = {
        "STREAM_TRIGGER_INTERVAL": "1 minute",
        "BATCH_RESET_GOLD": "no",
        "STREAM_CHECKPOINT_BASE": "/shared/cp",
        "STREAM_STARTING_OFFSETS": "earliest",
        "STREAM_FAIL_ON_DATA_LOSS": "TRUE",
        "STREAM_MAX_OFFSETS_PER_TRIGGER": "300",
        "STREAM_SHUFFLE_PARTITIONS": "64",
        "STREAM_RESET": "on",
    }
    settings = Settings.from_env("/w", env, max_offsets_per_trigger=600)
    assert settings.reset_gold is False and settings.stream_reset is True
    assert settings.checkpoints == "/shared/cp" and settings.starting_offsets == "earliest"
    assert settings.fail_on_data_loss is True and settings.stream_shuffle_partitions == 64
    assert settings.max_offsets_per_trigger == 600 and settings.trigger_interval == "1 minute"
    default = Settings.from_env("/w", {})
    assert default == Settings(root="/w") and default.reset_gold and not default.stream_reset
