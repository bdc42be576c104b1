"""All schemas of the data model, declared once for batch and streams."""

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_TEXT, _INT, _LONG, _REAL = StringType(), IntegerType(), LongType(), DoubleType()
_TIME, _WALL_TIME, _DAY, _FLAG = TimestampType(), TimestampNTZType(), DateType(), BooleanType()

# Field names and types of the two JSON messages.
SUBMISSION = _struct(
    submission_id=_TEXT,
    user_id=_TEXT,
    problem_id=_TEXT,
    status=_TEXT,
    execution_time_ms=_INT,
    memory_kb=_INT,
    client_ip=_TEXT,
    timestamp=_REAL,
)
METRIC = _struct(
    metric_id=_TEXT,
    user_id=_TEXT,
    metric_type=_TEXT,
    value=_REAL,
    timestamp=_REAL,
)


def fields_of(schema: StructType, *names: str) -> StructType:
    """The part of ``schema`` holding ``names``, so that only those are parsed."""
    return StructType([schema[name] for name in names])


# Metadata, as documents come: the key is called ``_id``.
DIMENSIONS = {
    "users": _struct(_id=_TEXT, full_name=_TEXT, class_cohort=_TEXT, major=_TEXT),
    "problems": _struct(
        _id=_TEXT,
        title=_TEXT,
        category=_TEXT,
        difficulty=_TEXT,
        time_limit_ms=_INT,
        instructor_id=_TEXT,
        instructor_name=_TEXT,
    ),
    "transactions": _struct(_id=_TEXT, user_id=_TEXT, plan_type=_TEXT, amount_usd=_REAL, date=_TIME),
    "ratings": _struct(_id=_TEXT, problem_id=_TEXT, user_id=_TEXT, rating_score=_INT, feedback=_TEXT),
}

# Name each metadata key takes in joins.
DIMENSION_KEYS = {
    "users": "user_id",
    "problems": "problem_id",
    "transactions": "transaction_id",
    "ratings": "rating_id",
}


def bronze(key: str) -> StructType:
    """Raw messages; rows without a key are the dead letters (``accepted`` false)."""
    return StructType(
        [
            StructField(key, _TEXT),
            StructField("ingest_timestamp", _TIME),
            StructField("raw_payload", _TEXT),
            StructField("reason", _TEXT),
            StructField("ingest_day", _DAY),
            StructField("accepted", _FLAG),
        ]
    )


BRONZE_KEYS = {"bronze_submissions": "submission_id", "bronze_metrics": "metric_id"}

TABLES = {
    "silver_submissions": _struct(
        problem_id=_TEXT,
        user_id=_TEXT,
        timestamp=_TIME,
        submission_id=_TEXT,
        status=_TEXT,
        execution_time_ms=_INT,
        memory_kb=_INT,
        day=_DAY,
    ),
    "silver_metrics": _struct(
        metric_id=_TEXT, user_id=_TEXT, metric_type=_TEXT, value=_REAL, timestamp=_REAL, day=_DAY
    ),
    "login_totals": _struct(user_id=_TEXT, seconds=_REAL, day=_DAY),
    "attempt_totals": _struct(
        user_id=_TEXT,
        problem_id=_TEXT,
        submissions=_LONG,
        passes=_LONG,
        fails=_LONG,
        exec_ms_sum=_LONG,
        exec_ms_rows=_LONG,
        day=_DAY,
    ),
    "user_features": _struct(
        user_id=_TEXT,
        total_submissions=_LONG,
        solved_count=_LONG,
        failed_count=_LONG,
        avg_exec_ms=_REAL,
        login_minutes=_REAL,
        fail_rate_pct=_REAL,
    ),
    "gold_engagement_scores": _struct(user_id=_TEXT, engagement_score=_LONG, last_updated=_TIME),
    "gold_difficulty_heatmap": _struct(
        problem_id=_TEXT,
        total_attempts=_LONG,
        failed_attempts=_LONG,
        fail_rate_pct=_REAL,
        category=_TEXT,
        last_updated=_TIME,
    ),
    "gold_subscription_revenue": _struct(
        plan_type=_TEXT, total_subscriptions=_LONG, total_revenue_usd=_REAL, last_updated=_TIME
    ),
    "gold_instructor_report_card": _struct(
        instructor_id=_TEXT,
        instructor_name=_TEXT,
        avg_rating=_REAL,
        total_ratings=_LONG,
        last_updated=_TIME,
    ),
    "gold_dropout_predictions": _struct(
        user_id=_TEXT, dropout_probability=_REAL, risk_label=_TEXT, last_updated=_TIME
    ),
    "gold_next_problem_recommendations": _struct(
        user_id=_TEXT,
        recommended_problem_id=_TEXT,
        recommendation_score=_REAL,
        last_updated=_TIME,
    ),
    "gold_adaptive_difficulty_profiles": _struct(
        user_id=_TEXT, performance_tier=_TEXT, recommended_difficulty=_TEXT, last_updated=_TIME
    ),
    "gold_live_leaderboard": _struct(
        rank_tier=_TEXT,
        user_id=_TEXT,
        total_solved=_LONG,
        recent_status=_TEXT,
        last_updated=_TIME,
    ),
    "gold_system_alerts": _struct(
        alert_id=_TEXT,
        user_id=_TEXT,
        description=_TEXT,
        triggered_at=_TIME,
        window_start=_TIME,
        alert_type=_TEXT,
    ),
}

# What streams append to: raw messages by the day they came, alerts by the day they were raised.
LOGS = {
    "bronze_submissions": bronze("submission_id"),
    "bronze_metrics": bronze("metric_id"),
    "gold_system_alerts": StructType([*TABLES["gold_system_alerts"].fields, StructField("raised_day", _DAY)]),
}

# Primary keys: what "last write wins" means for each table.
TABLE_KEYS = {
    "silver_submissions": ("submission_id",),
    "silver_metrics": ("metric_id",),
    "login_totals": ("user_id", "day"),
    "attempt_totals": ("user_id", "problem_id", "day"),
    "user_features": ("user_id",),
    "gold_engagement_scores": ("user_id",),
    "gold_difficulty_heatmap": ("problem_id",),
    "gold_subscription_revenue": ("plan_type",),
    "gold_instructor_report_card": ("instructor_id",),
    "gold_dropout_predictions": ("user_id",),
    "gold_next_problem_recommendations": ("user_id",),
    "gold_adaptive_difficulty_profiles": ("user_id",),
    "gold_live_leaderboard": ("rank_tier", "user_id"),
    "gold_system_alerts": ("alert_id",),
}

PARTITION_COLUMNS = {
    "silver_submissions": ("day",),
    "silver_metrics": ("day",),
    "login_totals": ("day",),
    "attempt_totals": ("day",),
    "bronze_submissions": ("ingest_day", "accepted"),
    "bronze_metrics": ("ingest_day", "accepted"),
    "gold_system_alerts": ("raised_day",),
}

# Tables that are replaced day by day, and the table whose list of days they follow.
BY_DAY = {
    "silver_submissions": "silver_submissions",
    "attempt_totals": "silver_submissions",
    "silver_metrics": "silver_metrics",
    "login_totals": "silver_metrics",
}

# Tables by day that can tell under which days an id is stored.
INDEXED = {"silver_submissions": "submission_id", "silver_metrics": "metric_id"}

BATCH_GOLD = (
    "gold_engagement_scores",
    "gold_difficulty_heatmap",
    "gold_subscription_revenue",
    "gold_instructor_report_card",
    "gold_dropout_predictions",
    "gold_next_problem_recommendations",
    "gold_adaptive_difficulty_profiles",
)

# The given tables, as far as they are used.  Declared, so that no job reads footers to learn them.
GIVEN = {
    "events": _struct(
        event_id=_LONG, ts=_WALL_TIME, user_id=_LONG, event_type=_TEXT, value=_REAL, props=_TEXT
    ),
    "customer": _struct(
        c_custkey=_LONG, c_name=_TEXT, c_nationkey=_INT, c_acctbal=_REAL, c_mktsegment=_TEXT
    ),
    "supplier": _struct(s_suppkey=_LONG, s_name=_TEXT, s_nationkey=_INT, s_acctbal=_REAL),
    "part": _struct(
        p_partkey=_LONG, p_name=_TEXT, p_brand=_TEXT, p_type=_TEXT, p_size=_INT, p_retailprice=_REAL
    ),
    "orders": _struct(
        o_orderkey=_LONG,
        o_custkey=_LONG,
        o_orderstatus=_TEXT,
        o_totalprice=_REAL,
        o_orderdate=_WALL_TIME,
        o_orderpriority=_TEXT,
    ),
    "lineitem": _struct(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_REAL,
        l_extendedprice=_REAL,
        l_discount=_REAL,
        l_tax=_REAL,
        l_returnflag=_TEXT,
        l_linestatus=_TEXT,
        l_shipdate=_WALL_TIME,
    ),
    "conversations": _struct(conv_id=_LONG, turn=_LONG, role=_TEXT, text=_TEXT),
    "pages": _struct(page_id=_LONG, url=_TEXT, html=_TEXT),
}

# Order of rows within the files of a partition; a leading minus means descending.
SORT_COLUMNS = {
    "silver_submissions": ("problem_id", "user_id", "-timestamp"),
    "silver_metrics": ("metric_type", "user_id"),
    "gold_live_leaderboard": ("rank_tier", "-total_solved", "user_id"),
    "bronze_submissions": ("ingest_timestamp",),
    "bronze_metrics": ("ingest_timestamp",),
    "gold_system_alerts": ("alert_type", "triggered_at"),
}
