"""What the boards show: report tables joined to metadata.

Boards with a limit pick their rows first and look up names for those only.  Equal values
are ordered by key, so a board shows the same rows every time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.config import Rules
from learnlens.functions import rules as R
from learnlens.functions import times
from learnlens.operators import features


def _top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    ranked = df.orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def _stamp(rows: DataFrame) -> list[str]:
    """When the row was stored, if it was."""
    return ["last_updated"] if "last_updated" in rows.columns else []


def _named(rows: DataFrame, users: DataFrame) -> DataFrame:
    return rows.join(users.select("user_id", "full_name", "class_cohort"), "user_id", "left")


def leaderboard(
    board: DataFrame, users: DataFrame, limit: int | None = 10, as_of: Column | None = None
) -> DataFrame:
    """With ``as_of`` the age of every row at that moment too."""
    order = F.desc("total_solved"), F.asc("user_id")
    rows = _named(_top(board, limit, *order), users).orderBy(*order)
    return rows if as_of is None else rows.withColumn("age", times.relative_age(F.col("last_updated"), as_of))


def leaderboard_kpis(board: DataFrame, users: DataFrame) -> DataFrame:
    """One row: name of the leader, number of users, passes of all."""
    leader = F.min_by("user_id", F.struct(-F.col("total_solved"), F.col("user_id")))
    totals = board.agg(
        leader.alias("user_id"),
        F.count("user_id").alias("active_users"),
        F.coalesce(F.sum("total_solved"), F.lit(0)).alias("total_solved"),
    )
    return _named(totals, users).select(
        F.col("full_name").alias("top_student"), "active_users", "total_solved"
    )


def quick_stats(board: DataFrame, heatmap: DataFrame, engagement: DataFrame, rules: Rules) -> DataFrame:
    """One row of status figures; zeros where a table is empty."""
    low = F.count_if(F.col("engagement_score") < rules.low_engagement)
    parts = [
        board.agg(
            F.count("user_id").alias("active_users"),
            F.sum("total_solved").alias("total_solved"),
        ),
        heatmap.agg(F.avg("fail_rate_pct").alias("avg_fail_rate")),
        engagement.agg(low.alias("low_engagement_users")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def figure(name: str) -> Column:
        return F.coalesce(F.max(name), F.lit(0).cast("bigint")).alias(name)

    return rows.agg(
        figure("active_users"),
        figure("total_solved"),
        F.round(F.coalesce(F.max("avg_fail_rate"), F.lit(0.0)), 2).alias("avg_fail_rate"),
        figure("low_engagement_users"),
    )


def status_line(submissions: DataFrame, metrics: DataFrame, rules: Rules) -> DataFrame:
    """The row of ``quick_stats`` from typed submissions and metrics, each read once.

    One aggregate over both sums per user and per problem (grouping sets); the figures are those of the
    leaderboard, the heatmap and the engagement table, none of which is built.
    """
    nothing = F.lit(0).cast("bigint")
    tries = features.attempts(submissions).select(
        "user_id",
        "problem_id",
        "submissions",
        "passes",
        "fails",
        F.when(F.col("problem_id").isNull(), nothing).otherwise(F.col("passes")).alias("solved"),
        F.lit(1).cast("bigint").alias("rows"),
        F.lit(0.0).alias("seconds"),
    )
    pauses = metrics.filter((F.col("metric_type") == R.LOGIN_METRIC) & F.col("user_id").isNotNull()).select(
        "user_id",
        F.lit(None).cast("string").alias("problem_id"),
        *[nothing.alias(name) for name in ("submissions", "passes", "fails", "solved", "rows")],
        F.col("value").alias("seconds"),
    )
    sums = [F.sum(name).alias(name) for name in ("submissions", "passes", "fails", "solved", "rows", "seconds")]
    each = tries.unionByName(pauses).groupingSets([["user_id"], ["problem_id"]], "user_id", "problem_id")
    totals = each.agg(F.grouping("problem_id").alias("of_user"), *sums)

    user = (F.col("of_user") == 1) & F.col("user_id").isNotNull() & (F.col("rows") > 0)
    problem = (F.col("of_user") == 0) & F.col("problem_id").isNotNull()
    score = R.engagement_score(F.coalesce("seconds", F.lit(0.0)) / 60.0, F.col("passes"), rules)
    rate = R.share_pct(F.col("fails"), F.col("submissions"))
    return totals.agg(
        F.count_if(user & (F.col("passes") > 0)).alias("active_users"),
        F.coalesce(F.sum(F.when(user, F.col("solved"))), nothing).alias("total_solved"),
        F.round(F.coalesce(F.avg(F.when(problem, rate)), F.lit(0.0)), 2).alias("avg_fail_rate"),
        F.count_if(user & (score < rules.low_engagement)).alias("low_engagement_users"),
    )


def heatmap(board: DataFrame, problems: DataFrame, limit: int | None = 12) -> DataFrame:
    order = F.desc("fail_rate_pct"), F.asc("problem_id")
    top = _top(board, limit, *order)
    return top.join(problems.select("problem_id", "title"), "problem_id", "left").orderBy(*order)


def failure_rollup(board: DataFrame, problems: DataFrame) -> DataFrame:
    """Failed attempts by category and title, with totals per category and overall."""
    titled = board.join(problems.select("problem_id", "title"), "problem_id", "left")
    return (
        titled.rollup("category", "title")
        .agg(F.sum("failed_attempts").alias("failed_attempts"), F.grouping_id().alias("level"))
        .select("category", "title", F.col("level").cast("bigint").alias("level"), "failed_attempts")
    )


def failure_share(board: DataFrame) -> DataFrame:
    """Each category's part of all failed attempts; the total is taken over the few categories."""
    total = F.sum("failed_attempts").over(Window.partitionBy(F.lit(0)))
    return (
        board.groupBy("category")
        .agg(F.sum("failed_attempts").alias("failed_attempts"))
        .withColumn("share_pct", R.share_pct(F.col("failed_attempts"), total))
    )


def revenue(board: DataFrame) -> DataFrame:
    return board.orderBy(F.desc("total_revenue_usd"), F.asc("plan_type"))


def revenue_totals(board: DataFrame) -> DataFrame:
    cents = F.sum(F.col("total_revenue_usd").cast("decimal(18,2)"))
    return board.agg(
        cents.cast("double").alias("total_revenue_usd"),
        F.sum("total_subscriptions").alias("total_subscriptions"),
    )


def instructors(board: DataFrame) -> DataFrame:
    return board.orderBy(F.desc("avg_rating"), F.asc("instructor_id"))


def risk_board(
    predictions: DataFrame, users: DataFrame, profiles: DataFrame, limit: int | None = None
) -> DataFrame:
    order = F.desc("dropout_probability"), F.asc("user_id")
    top = _top(predictions, limit, *order)
    return (
        _named(top, users)
        .join(profiles.select("user_id", "performance_tier", "recommended_difficulty"), "user_id", "left")
        .orderBy(*order)
        .select(
            "user_id",
            "full_name",
            "class_cohort",
            R.as_percent(F.col("dropout_probability")).alias("dropout_probability"),
            "risk_label",
            R.or_unknown("performance_tier"),
            R.or_unknown("recommended_difficulty"),
            *_stamp(predictions),
        )
    )


def recommendation_board(
    recommendations: DataFrame,
    users: DataFrame,
    problems: DataFrame,
    profiles: DataFrame,
    limit: int | None = 100,
) -> DataFrame:
    order = F.desc("recommendation_score"), F.asc("user_id")
    top = _top(recommendations, limit, *order)
    titles = problems.select(
        F.col("problem_id").alias("recommended_problem_id"), "title", "difficulty"
    )
    return (
        _named(top, users)
        .join(titles, "recommended_problem_id", "left")
        .join(profiles.select("user_id", "performance_tier", "recommended_difficulty"), "user_id", "left")
        .orderBy(*order)
        .select(
            "user_id",
            "full_name",
            "class_cohort",
            "recommended_problem_id",
            "title",
            "difficulty",
            "recommendation_score",
            R.or_unknown("performance_tier"),
            R.or_unknown("recommended_difficulty"),
            *_stamp(recommendations),
        )
    )


def tier_distribution(recommended: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tiers of the users who got a recommendation."""
    tiers = recommended.select("user_id").join(
        profiles.select("user_id", "performance_tier"), "user_id", "left"
    )
    return tiers.groupBy(R.or_unknown("performance_tier").alias("tier")).agg(F.count("*").alias("users"))


def alert_feed(alerts: DataFrame, users: DataFrame, limit: int | None = 50) -> DataFrame:
    """Newest alerts; a user without metadata appears under the id."""
    order = F.desc("triggered_at"), F.asc("alert_id")
    return (
        _named(_top(alerts, limit, *order), users)
        .orderBy(*order)
        .select(
            "alert_id",
            "triggered_at",
            "alert_type",
            F.coalesce("full_name", "user_id").alias("full_name"),
            R.or_unknown("class_cohort"),
            "description",
        )
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """One row with the number of alerts of either kind."""

    def of_kind(kind: str) -> Column:
        return F.count_if(F.col("alert_type") == kind).alias(kind.lower())

    return alerts.agg(of_kind(R.HIGH_LATENCY), of_kind(R.CHEAT_DETECTED))
