"""Batch report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.config import Rules
from learnlens.functions import rules as R
from learnlens.operators.features import total_attempts


def engagement(features: DataFrame, rules: Rules) -> DataFrame:
    score = R.engagement_score(F.col("login_minutes"), F.col("solved_count"), rules)
    return features.select("user_id", score.alias("engagement_score"))


def adaptive_profiles(features: DataFrame, rules: Rules) -> DataFrame:
    tier = R.performance_tier(F.col("solved_count"), F.col("fail_rate_pct"), rules)
    return features.select("user_id", tier.alias("performance_tier")).withColumn(
        "recommended_difficulty", R.recommended_difficulty(F.col("performance_tier"))
    )


def difficulty_heatmap(measures: DataFrame, problems: DataFrame) -> DataFrame:
    """Attempts and fail rate per problem; the metadata joins the totals, not the attempts."""
    totals = total_attempts(measures.filter(F.col("problem_id").isNotNull()), "problem_id")
    attempts, failed = F.col("submissions"), F.col("fails")
    return totals.join(problems.select("problem_id", "category"), "problem_id", "left").select(
        "problem_id",
        attempts.alias("total_attempts"),
        failed.alias("failed_attempts"),
        R.share_pct(failed, attempts).alias("fail_rate_pct"),
        "category",
    )


def subscription_revenue(transactions: DataFrame) -> DataFrame:
    """Money is added as decimal, so the total does not depend on the order of rows."""
    amount = F.col("amount_usd").cast("decimal(18,4)")
    return transactions.groupBy("plan_type").agg(
        F.count("plan_type").alias("total_subscriptions"),
        F.round(F.sum(amount), 2).cast("double").alias("total_revenue_usd"),
    )


def instructor_report(ratings: DataFrame, problems: DataFrame) -> DataFrame:
    """Mean rating per instructor.

    Ratings are summed per problem before the join: the join then moves one row per problem,
    and a problem that holds most ratings is reduced on the map side.
    """
    per_problem = ratings.groupBy("problem_id").agg(
        F.sum("rating_score").alias("score"), F.count("rating_score").alias("n")
    )
    taught = problems.select("problem_id", "instructor_id", "instructor_name").filter(
        F.col("instructor_id").isNotNull()
    )
    return (
        per_problem.join(taught, "problem_id")
        .groupBy("instructor_id", "instructor_name")
        .agg(F.sum("score").alias("score"), F.sum("n").alias("total_ratings"))
        .select(
            "instructor_id",
            "instructor_name",
            F.round(F.try_divide("score", "total_ratings"), 2).alias("avg_rating"),
            "total_ratings",
        )
    )


def interactions(measures: DataFrame) -> DataFrame:
    """Passes per user and problem, the implicit rating of the recommender."""
    known = F.col("user_id").isNotNull() & F.col("problem_id").isNotNull()
    passed = measures.filter(known & (F.col("passes") > 0))
    return passed.groupBy("user_id", "problem_id").agg(
        F.sum("passes").cast("double").alias("rating")
    )
