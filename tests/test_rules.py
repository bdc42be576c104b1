from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from learnlens.config import Rules
from learnlens.functions import rules as R
from learnlens.functions import times

RULES = Rules()


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("v")).collect()]


def test_tiers_at_their_edges(spark):
    cases = {
        (11, 0.0): "NOVICE",
        (12, 0.0): "INTERMEDIATE",
        (34, 0.0): "INTERMEDIATE",
        (35, 0.0): "EXPERT",
        (35, 34.99): "EXPERT",
        (35, 35.0): "INTERMEDIATE",
        (35, 64.99): "INTERMEDIATE",
        (35, 65.0): "NOVICE",
    }
    tier = R.performance_tier(F.col("s"), F.col("f"), RULES)
    assert values(spark, list(cases), "s bigint, f double", tier) == list(cases.values())


def test_difficulty_follows_the_tier(spark):
    got = values(
        spark, [("NOVICE",), ("INTERMEDIATE",), ("EXPERT",)], "t string", R.recommended_difficulty(F.col("t"))
    )
    assert got == ["Easy", "Medium", "Hard"]


def test_label_needs_all_three(spark):
    cases = {
        (65.0, 34.99, 11): 1.0,
        (64.99, 34.99, 11): 0.0,
        (65.0, 35.0, 11): 0.0,
        (65.0, 34.99, 12): 0.0,
        (None, 0.0, 0): 0.0,
    }
    label = R.dropout_label(F.col("f"), F.col("l"), F.col("s"), RULES)
    assert values(spark, list(cases), "f double, l double, s bigint", label) == list(cases.values())


def test_bands(spark):
    got = values(
        spark,
        [(0.4499,), (0.45,), (0.6999,), (0.7,), (None,)],
        "p double",
        R.risk_band(F.col("p"), RULES),
    )
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "LOW"]


def test_engagement_rounds_half_up_and_passes_the_int_range(spark):
    got = values(
        spark,
        [(0.125, 1), (0.0, 0), (0.0, 10**9)],
        "l double, s bigint",
        R.engagement_score(F.col("l"), F.col("s"), RULES),
    )
    assert got == [19, 0, 18 * 10**9]


def test_share_is_null_over_nothing(spark):
    got = values(spark, [(1, 3), (0, 0), (2, 3)], "a bigint, b bigint", R.share_pct(F.col("a"), F.col("b")))
    assert got == [33.33, None, 66.67]


def test_alert_texts(spark):
    assert values(spark, [(5500.0,)], "v double", R.latency_text(F.col("v"))) == [
        "Execution latency exceeded 5s: 5500.0 ms"
    ]
    assert values(spark, [(3, 2)], "n bigint, i bigint", R.burst_text(F.col("n"), F.col("i"))) == [
        "Window anomaly: submissions_30s=3, distinct_ips=2"
    ]


NOW = datetime(2024, 5, 1, 12, 0, 0)


@pytest.mark.parametrize(
    ("age", "text"),
    [
        (timedelta(seconds=-5), "Just now"),
        (timedelta(seconds=59, microseconds=999999), "Just now"),
        (timedelta(seconds=60), "1 mins ago"),
        (timedelta(seconds=3599), "59 mins ago"),
        (timedelta(hours=1), "1 hours ago"),
        (timedelta(hours=24) - timedelta(microseconds=1), "23 hours ago"),
        (timedelta(days=1), "1 days ago"),
        (timedelta(days=400), "400 days ago"),
    ],
)
def test_relative_age(spark, age, text):
    got = values(spark, [(NOW - age, NOW)], "t timestamp, n timestamp", times.relative_age(F.col("t"), F.col("n")))
    assert got == [text]


def test_relative_age_of_nothing(spark):
    got = values(spark, [(None, NOW)], "t timestamp, n timestamp", times.relative_age(F.col("t"), F.col("n")))
    assert got == ["Unknown"]
