"""Solved counts, for batch and for the update-mode stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions import rules as R


def solved_counts(submissions: DataFrame) -> DataFrame:
    """Passes per user; solving a problem again counts again."""
    return (
        submissions.filter((F.col("status") == R.PASS) & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count("problem_id").alias("total_solved"))
        .select(
            F.lit(R.GLOBAL_TIER).alias("rank_tier"),
            "user_id",
            "total_solved",
            F.lit(R.PASS).alias("recent_status"),
        )
    )


def by_cohort(leaderboard: DataFrame, users: DataFrame) -> DataFrame:
    """The same counts ranked within cohorts rather than globally."""
    return leaderboard.join(users.select("user_id", "class_cohort"), "user_id", "left").select(
        F.coalesce("class_cohort", F.lit(R.UNKNOWN)).alias("rank_tier"),
        "user_id",
        "total_solved",
        "recent_status",
    )
