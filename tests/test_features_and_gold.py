from learnlens.config import Rules
from learnlens.operators import features, gold, leaderboard
from learnlens.operators.dedup import latest_by_key
from learnlens.operators.numbering import numbered

SUBMISSION = "submission_id string, user_id string, problem_id string, status string, execution_time_ms int"
METRIC = "metric_id string, user_id string, metric_type string, value double"
PROBLEM = "problem_id string, category string, instructor_id string, instructor_name string"
RULES = Rules()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def submissions(spark, *data):
    return spark.createDataFrame(list(data), SUBMISSION)


def metrics(spark, *data):
    return spark.createDataFrame(list(data), METRIC)


def login(metric_rows):
    return features.login_minutes(features.login_seconds(metric_rows, "user_id"))


def test_features_count_null_status_only_in_the_total(spark):
    silver = submissions(
        spark,
        ("1", "u", "p", "Pass", 10),
        ("2", "u", "p", None, 30),
        ("3", "u", "q", "Wrong Answer", None),
        ("4", None, "q", "Pass", 1),
    )
    minutes = login(metrics(spark, ("m", "u", "submission_interval_sec", 90.0)))
    got = rows(features.user_features(features.attempts(silver), minutes))
    assert got == [("u", 3, 1, 1, 20.0, 1.5, 33.33)]


def test_features_without_metrics_or_run_times(spark):
    silver = submissions(spark, ("1", "u", "p", "Pass", None), (None, "v", "p", "Pass", 5))
    minutes = login(metrics(spark))
    got = rows(features.user_features(features.attempts(silver), minutes))
    assert got == [("u", 1, 1, 0, 0.0, 0.0, 0.0), ("v", 0, 1, 0, 5.0, 0.0, 0.0)]


def test_totals_of_totals_equal_totals_of_attempts(spark):
    silver = submissions(
        spark,
        *[(str(i), f"u{i % 7}", f"p{i % 5}", "Pass" if i % 3 else "Runtime Error", i) for i in range(500)],
    )
    minutes = login(metrics(spark))
    direct = features.attempts(silver)
    summed = features.total_attempts(direct, "user_id", "problem_id")
    assert rows(features.user_features(direct, minutes)) == rows(features.user_features(summed, minutes))
    problems = spark.createDataFrame([("p1", "a", None, None)], PROBLEM)
    assert rows(gold.difficulty_heatmap(direct, problems)) == rows(gold.difficulty_heatmap(summed, problems))
    assert rows(gold.interactions(direct)) == rows(gold.interactions(summed))


def test_login_counts_interval_metrics_only(spark):
    got = login(
        metrics(
            spark,
            ("1", "u", "submission_interval_sec", 30.0),
            ("2", "u", "submission_interval_sec", None),
            ("3", "u", "memory_kb", 600.0),
            ("4", None, "submission_interval_sec", 60.0),
        )
    )
    assert rows(got) == [("u", 0.5)]


def test_heatmap_keeps_problems_without_metadata_and_without_attempts_rate(spark):
    silver = submissions(
        spark,
        ("1", "u", "p1", "Pass", 1),
        ("2", "u", "p1", "Wrong Answer", 1),
        ("3", "u", "p2", "Wrong Answer", 1),
        (None, "u", "p3", "Pass", 1),
        ("5", "u", None, "Pass", 1),
    )
    problems = spark.createDataFrame([("p1", "graphs", None, None), ("p9", "trees", None, None)], PROBLEM)
    assert rows(gold.difficulty_heatmap(features.attempts(silver), problems), "problem_id") == [
        ("p1", 2, 1, 50.0, "graphs"),
        ("p2", 1, 1, 100.0, None),
        ("p3", 0, 0, None, None),
    ]


def test_revenue_counts_nothing_for_the_null_plan(spark):
    transactions = spark.createDataFrame(
        [("Basic", 5.0), ("Basic", 0.1), ("Basic", 0.2), (None, 9.0), ("Pro", None)],
        "plan_type string, amount_usd double",
    )
    assert rows(gold.subscription_revenue(transactions), "plan_type") == [
        (None, 0, 9.0),
        ("Basic", 3, 5.3),
        ("Pro", 1, None),
    ]


def test_instructor_report_leaves_out_unknown_instructors(spark):
    problems = spark.createDataFrame(
        [("p1", "c", "i1", "Ann"), ("p2", "c", "i1", "Ann"), ("p3", "c", None, None), ("p4", "c", "i1", "Anne")],
        PROBLEM,
    )
    ratings = spark.createDataFrame(
        [("p1", 5), ("p1", 4), ("p2", 4), ("p2", None), ("p3", 1), ("p7", 1), (None, 1), ("p4", 2)],
        "problem_id string, rating_score int",
    )
    assert rows(gold.instructor_report(ratings, problems)) == [
        ("i1", "Ann", 4.33, 3),
        ("i1", "Anne", 2.0, 1),
    ]


def test_empty_inputs_give_empty_reports(spark):
    nothing = features.attempts(submissions(spark))
    minutes = login(metrics(spark))
    users = features.user_features(nothing, minutes)
    problems = spark.createDataFrame([], PROBLEM)
    ratings = spark.createDataFrame([], "problem_id string, rating_score int")
    for df in (
        users,
        gold.engagement(users, RULES),
        gold.adaptive_profiles(users, RULES),
        gold.difficulty_heatmap(nothing, problems),
        gold.instructor_report(ratings, problems),
        gold.interactions(nothing),
        leaderboard.solved_counts(submissions(spark)),
    ):
        assert df.collect() == []


def test_leaderboard_counts_solving_again(spark):
    silver = submissions(
        spark,
        ("1", "u", "p", "Pass", 1),
        ("2", "u", "p", "Pass", 1),
        ("3", "v", None, "Pass", 1),
        ("4", "w", "p", "Runtime Error", 1),
        ("5", None, "p", "Pass", 1),
    )
    board = leaderboard.solved_counts(silver)
    assert rows(board) == [("Global", "u", 2, "Pass"), ("Global", "v", 0, "Pass")]
    users = spark.createDataFrame([("u", "K21")], "user_id string, class_cohort string")
    assert rows(leaderboard.by_cohort(board, users)) == [("K21", "u", 2, "Pass"), ("Unknown", "v", 0, "Pass")]


def test_latest_by_key_against_brute_force(spark):
    # a third of all rows share one key
    data = [(0 if i % 3 == 0 else i % 50, (i * 37) % 11, f"x{(i * 7) % 13}", i % 5) for i in range(3000)]
    data.append((None, 99, "z", 9))
    df = spark.createDataFrame(data, "k int, o int, a string, b int")
    expected = {}
    for k, o, a, b in data:
        if k is not None:
            expected[k] = max(expected.get(k, (-1, "", -1)), (o, a, b))
    got = {r.k: (r.o, r.a, r.b) for r in latest_by_key(df, ("k",), ("o",)).collect()}
    assert got == expected


def test_latest_by_key_keeps_column_order_and_null_values(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 0), ("b", None, None)], "k string, v string, t int")
    latest = latest_by_key(df, ("k",), ("t",))
    assert latest.columns == ["k", "v", "t"]
    assert rows(latest, "k") == [("a", None, 1), ("b", None, None)]


def test_latest_by_key_of_keys_alone(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(latest_by_key(df, ("k",))) == [(1,)]


def test_numbers_are_unique_small_and_repeatable(spark):
    df = spark.createDataFrame([(f"user_{i % 3000}",) for i in range(9000)], "u string")
    first = {r.u: r.n for r in numbered(df, "u", "n", 4).collect()}
    again = {r.u: r.n for r in numbered(df.repartition(7), "u", "n", 4).collect()}
    assert len(first) == 3000 == len(set(first.values()))
    assert first == again
    assert 0 <= min(first.values()) and max(first.values()) < 2 * 3000
