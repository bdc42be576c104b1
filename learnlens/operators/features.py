"""Per-user and per-problem measures of submissions.

All measures are sums, so they may be taken from single submissions or from totals summed
before.  The nightly job sums once per user, problem and day and derives the rest from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.config import Rules
from learnlens.functions import rules as R

_MEASURES = ("submissions", "passes", "fails", "exec_ms_sum", "exec_ms_rows")


def attempts(submissions: DataFrame, *keep: str) -> DataFrame:
    """Additive measures of each submission.  A null status is neither a pass nor a fail."""

    def one_if(condition):
        return F.coalesce(condition.cast("bigint"), F.lit(0).cast("bigint"))

    status, exec_ms = F.col("status"), F.col("execution_time_ms")
    return submissions.select(
        "user_id",
        "problem_id",
        *keep,
        one_if(F.col("submission_id").isNotNull()).alias("submissions"),
        one_if(status == R.PASS).alias("passes"),
        one_if(status != R.PASS).alias("fails"),
        F.coalesce(exec_ms.cast("bigint"), F.lit(0).cast("bigint")).alias("exec_ms_sum"),
        one_if(exec_ms.isNotNull()).alias("exec_ms_rows"),
    )


def total_attempts(measures: DataFrame, *keys: str) -> DataFrame:
    return measures.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in _MEASURES])


def login_seconds(metrics: DataFrame, *keys: str) -> DataFrame:
    """Seconds between submissions, summed by ``keys``."""
    intervals = metrics.filter((F.col("metric_type") == R.LOGIN_METRIC) & F.col("user_id").isNotNull())
    return intervals.groupBy(*keys).agg(F.sum("value").alias("seconds"))


def login_minutes(seconds: DataFrame) -> DataFrame:
    """Minutes per user, the proxy of time spent."""
    return seconds.groupBy("user_id").agg((F.sum("seconds") / 60.0).alias("login_minutes"))


def user_features(measures: DataFrame, login: DataFrame) -> DataFrame:
    """One row per user: attempts, passes, fails, mean run time, login minutes, fail rate."""
    per_user = total_attempts(measures.filter(F.col("user_id").isNotNull()), "user_id")
    total, failed = F.col("submissions"), F.col("fails")
    mean_ms = F.try_divide(F.col("exec_ms_sum"), F.col("exec_ms_rows"))
    return per_user.join(login, "user_id", "left").select(
        "user_id",
        total.alias("total_submissions"),
        F.col("passes").alias("solved_count"),
        failed.alias("failed_count"),
        F.coalesce(mean_ms, F.lit(0.0)).alias("avg_exec_ms"),
        F.coalesce("login_minutes", F.lit(0.0)).alias("login_minutes"),
        F.coalesce(R.share_pct(failed, total), F.lit(0.0)).alias("fail_rate_pct"),
    )


def with_label(features: DataFrame, rules: Rules) -> DataFrame:
    return features.withColumn(
        "label",
        R.dropout_label(F.col("fail_rate_pct"), F.col("login_minutes"), F.col("solved_count"), rules),
    )


def class_balance(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("users"))
