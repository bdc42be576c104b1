from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from learnlens.config import Learning, Rules
from learnlens.operators import dropout, features, recommend
from learnlens.plans import catalogue
from learnlens.sources.driver_tables import DriverTables

MIDDLE = "/root/testdata/sf0.01"
RULES, LEARNING = Rules(), Learning()


def feature_rows(spark, *data):
    return spark.createDataFrame(
        list(data),
        "user_id string, total_submissions bigint, solved_count bigint, failed_count bigint,"
        " avg_exec_ms double, login_minutes double, fail_rate_pct double",
    )


def test_one_class_gives_constants(spark):
    safe = feature_rows(spark, ("a", 10, 10, 0, 1.0, 50.0, 0.0))
    risky = feature_rows(spark, ("b", 10, 1, 9, 1.0, 5.0, 90.0))
    assert [tuple(r) for r in dropout.predictions(safe, RULES, LEARNING).collect()] == [("a", 0.2, "LOW")]
    assert [tuple(r) for r in dropout.predictions(risky, RULES, LEARNING).collect()] == [("b", 0.8, "HIGH")]
    assert dropout.predictions(safe.limit(0), RULES, LEARNING).collect() == []


@pytest.fixture(scope="module")
def middle(spark):
    return catalogue._features(DriverTables(spark, MIDDLE)).cache()


def test_regression_separates_the_label(spark, middle):
    labelled = features.with_label(middle, RULES)
    assert features.class_balance(labelled).count() == 2
    scored = dropout.predictions(middle, RULES, LEARNING)
    joined = scored.join(labelled.select("user_id", "label"), "user_id").cache()
    assert joined.count() == middle.count()
    bounds = joined.agg(F.min("dropout_probability"), F.max("dropout_probability")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1
    auc = BinaryClassificationEvaluator(rawPredictionCol="dropout_probability", labelCol="label").evaluate(joined)
    assert auc > 0.95
    wrong = joined.filter(
        F.col("risk_label")
        != F.when(F.col("dropout_probability") >= 0.7, "HIGH")
        .when(F.col("dropout_probability") >= 0.45, "MEDIUM")
        .otherwise("LOW")
    )
    assert wrong.count() == 0


def test_regression_repeats(spark, middle):
    def scores():
        rows = dropout.predictions(middle, RULES, LEARNING).collect()
        return {r.user_id: round(r.dropout_probability, 9) for r in rows}

    assert scores() == scores()


def test_one_recommendation_per_user_with_a_pass(spark):
    t = DriverTables(spark, SMALL)
    interactions = catalogue.registered()["als_interactions"](spark, SMALL)
    passed = {r.user_id for r in interactions.select("user_id").distinct().collect()}
    known = {r.problem_id for r in interactions.select("problem_id").distinct().collect()}
    rows = catalogue._recommendations(t).collect()
    assert sorted(r.user_id for r in rows) == sorted(passed)
    assert {r.recommended_problem_id for r in rows} <= known
    assert all(r.recommendation_score == round(r.recommendation_score, 4) for r in rows)
    again = catalogue._recommendations(t).collect()
    assert {r.user_id: r.recommended_problem_id for r in rows} == {r.user_id: r.recommended_problem_id for r in again}


def test_users_of_two_groups_get_problems_of_their_group(spark):
    pairs = [(f"a{u}", f"x{p}", 1.0) for u in range(12) for p in range(6) if (u + p) % 4]
    pairs += [(f"b{u}", f"y{p}", 1.0) for u in range(12) for p in range(6) if (u + p) % 4]
    df = spark.createDataFrame(pairs, "user_id string, problem_id string, rating double")
    rows = recommend.next_problem(df, LEARNING).collect()
    assert len(rows) == 24
    assert all(r.recommended_problem_id[0] == {"a": "x", "b": "y"}[r.user_id[0]] for r in rows)


def test_recommendations_do_not_hang_on_the_shuffle_width(spark):
    interactions = catalogue.registered()["als_interactions"](spark, SMALL).cache()
    width = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in ("2", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = recommend.next_problem(interactions, LEARNING).collect()
            found.append(sorted((r.user_id, r.recommended_problem_id, r.recommendation_score) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert found[0] == found[1] == found[2]


def test_nobody_passed(spark):
    df = spark.createDataFrame([], "user_id string, problem_id string, rating double")
    got = recommend.next_problem(df, LEARNING)
    assert got.columns == ["user_id", "recommended_problem_id", "recommendation_score"]
    assert got.collect() == []


def test_weights_are_those_of_the_optimum(spark, middle):
    found = {r.term: r for r in dropout.weights(middle, RULES, LEARNING).collect()}
    assert set(found) == {"intercept", *dropout.MODEL_INPUTS}
    assert all(abs(r.gradient) < 1e-5 for r in found.values())
    assert found["fail_rate_pct"].weight > 0 > found["solved_count"].weight
    one_class = feature_rows(spark, ("a", 10, 10, 0, 1.0, 50.0, 0.0))
    assert dropout.weights(one_class, RULES, LEARNING).collect() == []


def test_an_input_that_never_changes_has_no_weight(spark):
    rows = [(f"u{i}", 10, i % 5, 10 - i % 5, 7.0, 5.0 + i % 3, 90.0 if i % 2 else 10.0) for i in range(40)]
    found = {r.term: r for r in dropout.weights(feature_rows(spark, *rows), RULES, LEARNING).collect()}
    assert "avg_exec_ms" not in found and "fail_rate_pct" in found
    assert all(abs(r.gradient) < 1e-5 for r in found.values())


def pairs(spark, *data):
    return spark.createDataFrame(list(data), "user_id string, problem_id string, rating double")


@pytest.fixture(scope="module")
def factors(spark):
    interactions = catalogue.registered()["als_interactions"](spark, SMALL).cache()
    return recommend.fitted(interactions, LEARNING)


def test_factors_of_users_are_the_optimum(factors):
    assert recommend.unbalanced_users(factors, LEARNING, 1e-5).count() == 0
    # and the check sees factors that are not: those of a stronger penalty
    assert recommend.unbalanced_users(factors, replace(LEARNING, als_reg_param=0.8)).count() > 0


def test_the_best_unsolved_problem_by_brute_force(factors):
    x = {r.id: r.features for r in factors.model.userFactors.collect()}
    y = {r.id: r.features for r in factors.model.itemFactors.collect()}
    solved = {(r.user_number, r.problem_number) for r in factors.ratings.collect()}
    got = {r.user_number: r for r in recommend.best_unsolved(factors).collect()}
    for user, own in x.items():
        scores = {i: sum(a * b for a, b in zip(own, other, strict=True)) for i, other in y.items() if (user, i) not in solved}
        assert (user in got) == bool(scores)
        if scores:
            assert (user, got[user].problem_number) not in solved
            assert got[user].score == pytest.approx(max(scores.values()), abs=1e-5)


def test_who_has_solved_all_gets_no_problem(spark):
    data = [("all", f"p{i}", 1.0) for i in range(12)] + [("most", f"p{i}", 1.0) for i in range(11)] + [("one", "p3", 5.0)]
    got = recommend.next_problem(pairs(spark, *data), replace(LEARNING, exclude_solved=True)).collect()
    found = {r.user_id: r.recommended_problem_id for r in got}
    assert found["most"] == "p11" and set(found) == {"most", "one"} and found["one"] != "p3"
    nobody = recommend.next_problem(pairs(spark, *data).limit(0), replace(LEARNING, exclude_solved=True))
    assert nobody.collect() == []
