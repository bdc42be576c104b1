from datetime import datetime

from learnlens.config import Rules
from learnlens.plans import serving

NOW = datetime(2024, 1, 1)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def board(spark, *pairs):
    return frame(spark, "user_id string, total_solved bigint", *pairs)


def users(spark):
    return frame(spark, "user_id string, full_name string, class_cohort string", ("a", "Ann", "K21"), ("b", "Bo", "K22"))


def problems(spark):
    return frame(
        spark,
        "problem_id string, title string, category string, difficulty string",
        ("p1", "Walk", "graphs", "Easy"),
        ("p2", "Sort", "lists", "Hard"),
    )


def heat(spark, *rows):
    return frame(spark, "problem_id string, failed_attempts bigint, fail_rate_pct double, category string", *rows)


def profiles(spark, *rows):
    return frame(spark, "user_id string, performance_tier string, recommended_difficulty string", *rows)


def test_leaderboard_orders_ties_by_user_and_keeps_unknown_users(spark):
    rows = serving.leaderboard(board(spark, ("c", 5), ("b", 5), ("a", 1), ("d", 9)), users(spark), limit=3).collect()
    assert [(r.user_id, r.full_name) for r in rows] == [("d", None), ("b", "Bo"), ("c", None)]
    assert len(serving.leaderboard(board(spark, ("a", 1), ("b", 2)), users(spark), limit=None).collect()) == 2


def test_kpis(spark):
    row = serving.leaderboard_kpis(board(spark, ("b", 5), ("a", 5), ("c", 1)), users(spark)).first()
    assert tuple(row) == ("Ann", 3, 11)
    assert tuple(serving.leaderboard_kpis(board(spark), users(spark)).first()) == (None, 0, 0)


def test_quick_stats_and_their_zeros(spark):
    engagement = frame(spark, "user_id string, engagement_score bigint", ("a", 99), ("b", 100))
    full = serving.quick_stats(
        board(spark, ("a", 2), ("b", 3)),
        heat(spark, ("p1", 1, 10.0, "x"), ("p2", 1, 20.55, "x")),
        engagement,
        Rules(),
    )
    assert [tuple(r) for r in full.collect()] == [(2, 5, 15.28, 1)]
    empty = serving.quick_stats(board(spark), heat(spark), engagement.limit(0), Rules())
    assert [tuple(r) for r in empty.collect()] == [(0, 0, 0.0, 0)]


def test_heatmap_board(spark):
    rows = serving.heatmap(
        heat(spark, ("p2", 1, 50.0, "x"), ("p1", 1, 50.0, "x"), ("p9", 1, 60.0, None)), problems(spark), limit=2
    ).collect()
    assert [(r.problem_id, r.title) for r in rows] == [("p9", None), ("p1", "Walk")]


def test_failures_roll_up(spark):
    data = heat(spark, ("p1", 3, 1.0, "graphs"), ("p2", 1, 1.0, "lists"), ("p9", 4, 1.0, None))
    got = {(r.category, r.title, r.level): r.failed_attempts for r in serving.failure_rollup(data, problems(spark)).collect()}
    assert got == {
        ("graphs", "Walk", 0): 3,
        ("lists", "Sort", 0): 1,
        (None, None, 0): 4,
        ("graphs", None, 1): 3,
        ("lists", None, 1): 1,
        (None, None, 1): 4,
        (None, None, 3): 8,
    }


def test_failure_shares(spark):
    data = heat(spark, ("p1", 3, 1.0, "graphs"), ("p2", 1, 1.0, "lists"), ("p3", 2, 1.0, "graphs"))
    got = {r.category: (r.failed_attempts, r.share_pct) for r in serving.failure_share(data).collect()}
    assert got == {"graphs": (5, 83.33), "lists": (1, 16.67)}
    zero = serving.failure_share(heat(spark, ("p1", 0, 0.0, "graphs"))).first()
    assert zero.share_pct is None


def test_revenue_boards(spark):
    data = frame(
        spark,
        "plan_type string, total_subscriptions bigint, total_revenue_usd double",
        ("B", 1, 5.1),
        ("A", 2, 5.1),
        ("C", 3, 0.2),
    )
    assert [r.plan_type for r in serving.revenue(data).collect()] == ["A", "B", "C"]
    assert tuple(serving.revenue_totals(data).first()) == (10.4, 6)


def test_instructor_board(spark):
    data = frame(spark, "instructor_id string, avg_rating double", ("i2", 4.0), ("i1", 4.0), ("i3", 5.0))
    assert [r.instructor_id for r in serving.instructors(data).collect()] == ["i3", "i1", "i2"]


def test_risk_board_knows_the_unknown(spark):
    scored = frame(
        spark,
        "user_id string, dropout_probability double, risk_label string",
        ("a", 0.12345, "LOW"),
        ("z", 0.9, "HIGH"),
        ("b", 0.9, "HIGH"),
    )
    got = serving.risk_board(scored, users(spark), profiles(spark, ("a", "NOVICE", "Easy"))).collect()
    assert [tuple(r) for r in got] == [
        ("b", "Bo", "K22", 90.0, "HIGH", "Unknown", "Unknown"),
        ("z", None, None, 90.0, "HIGH", "Unknown", "Unknown"),
        ("a", "Ann", "K21", 12.35, "LOW", "NOVICE", "Easy"),
    ]


def test_recommendation_board(spark):
    recs = frame(
        spark,
        "user_id string, recommended_problem_id string, recommendation_score double",
        ("b", "p1", 0.5),
        ("a", "p9", 0.5),
        ("c", "p2", 0.1),
    )
    got = serving.recommendation_board(
        recs, users(spark), problems(spark), profiles(spark, ("b", "EXPERT", "Hard")), limit=2
    ).collect()
    assert [(r.user_id, r.title, r.difficulty, r.performance_tier) for r in got] == [
        ("a", None, None, "Unknown"),
        ("b", "Walk", "Easy", "EXPERT"),
    ]


def test_tiers_are_those_of_recommended_users(spark):
    data = profiles(spark, ("a", "NOVICE", "Easy"), ("b", "EXPERT", "Hard"), ("c", "NOVICE", "Easy"))
    recommended = frame(spark, "user_id string", ("a",), ("c",), ("unprofiled",))
    got = serving.tier_distribution(recommended, data).collect()
    assert sorted(tuple(r) for r in got) == [("NOVICE", 2), ("Unknown", 1)]


def test_alert_feed_and_counts(spark):
    data = frame(
        spark,
        "alert_id string, alert_type string, user_id string, description string, triggered_at timestamp",
        ("2", "HIGH_LATENCY", "a", "x", NOW),
        ("1", "HIGH_LATENCY", "zed", "y", NOW),
        ("3", "HIGH_LATENCY", "a", "old", datetime(2023, 1, 1)),
    )
    feed = serving.alert_feed(data, users(spark), limit=2).collect()
    assert [(r.alert_id, r.full_name, r.class_cohort) for r in feed] == [("1", "zed", "Unknown"), ("2", "Ann", "K21")]
    assert tuple(serving.alert_counts(data).first()) == (3, 0)
    assert tuple(serving.alert_counts(data.limit(0)).first()) == (0, 0)
