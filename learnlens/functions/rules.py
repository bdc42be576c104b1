"""Business rules as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnlens.config import Rules

# Words that appear in stored and served rows.
PASS = "Pass"
LOGIN_METRIC = "submission_interval_sec"
LATENCY_METRIC = "execution_time_ms"
HIGH_LATENCY = "HIGH_LATENCY"
CHEAT_DETECTED = "CHEAT_DETECTED"
GLOBAL_TIER = "Global"
UNKNOWN_IP = "unknown"
UNKNOWN = "Unknown"
LATENCY_TEXT = ("Execution latency exceeded 5s: ", " ms")
BURST_TEXT = ("Window anomaly: submissions_30s=", ", distinct_ips=")
DIFFICULTY_OF_TIER = {"NOVICE": "Easy", "INTERMEDIATE": "Medium", "EXPERT": "Hard"}


def share_pct(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent, two decimals; null when ``whole`` is zero."""
    return F.round(F.try_divide(part, whole) * 100.0, 2)


def engagement_score(login_minutes: Column, solved: Column, rules: Rules) -> Column:
    # bigint: a very active user passes the int range, which an ANSI cast would reject
    points = login_minutes * rules.points_per_login_minute + solved * rules.points_per_solved
    return F.round(points).cast("bigint")


def dropout_label(fail_rate: Column, login_minutes: Column, solved: Column, rules: Rules) -> Column:
    at_risk = (
        (fail_rate >= rules.label_fail_rate)
        & (login_minutes < rules.label_login_minutes)
        & (solved < rules.label_solved)
    )
    return F.coalesce(at_risk, F.lit(False)).cast("double")


def single_class_probability(label: Column, rules: Rules) -> Column:
    return F.when(label > 0, rules.single_class_positive).otherwise(rules.single_class_negative)


def risk_band(probability: Column, rules: Rules) -> Column:
    return (
        F.when(probability >= rules.risk_high, "HIGH")
        .when(probability >= rules.risk_medium, "MEDIUM")
        .otherwise("LOW")
    )


def performance_tier(solved: Column, fail_rate: Column, rules: Rules) -> Column:
    def weak(min_solved: int, max_fail_rate: float) -> Column:
        return (solved < min_solved) | (fail_rate >= max_fail_rate)

    return (
        F.when(weak(rules.novice_solved, rules.novice_fail_rate), "NOVICE")
        .when(weak(rules.intermediate_solved, rules.intermediate_fail_rate), "INTERMEDIATE")
        .otherwise("EXPERT")
    )


def recommended_difficulty(tier: Column) -> Column:
    return (
        F.when(tier == "NOVICE", DIFFICULTY_OF_TIER["NOVICE"])
        .when(tier == "INTERMEDIATE", DIFFICULTY_OF_TIER["INTERMEDIATE"])
        .otherwise(DIFFICULTY_OF_TIER["EXPERT"])
    )


def latency_text(value: Column) -> Column:
    before, after = LATENCY_TEXT
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def burst_text(submissions: Column, ips: Column) -> Column:
    before, between = BURST_TEXT
    return F.concat(F.lit(before), submissions.cast("string"), F.lit(between), ips.cast("string"))


def alert_key(*parts: Column) -> Column:
    """Deterministic alert id, so that a replay writes the same alert again."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def as_percent(probability: Column) -> Column:
    return F.round(probability * 100, 2)


def or_unknown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(UNKNOWN)).alias(name)
