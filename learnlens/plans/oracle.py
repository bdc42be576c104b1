"""The same answers in DuckDB SQL, stated on the given tables without the engine's parsing."""

from __future__ import annotations


def _half_up(expression: str, digits: int = 2) -> str:
    """Round the printed double half up, as Spark does."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"


_SUBMISSIONS = """
submissions AS (
  SELECT CAST(event_id AS VARCHAR) AS submission_id,
         'user_' || user_id AS user_id,
         'prob_' || json_extract_string(props, '$.k') AS problem_id,
         CASE WHEN value < 10 + 12 * (user_id % 10) THEN 'Pass'
              WHEN event_id % 3 = 0 THEN 'Time Limit Exceeded'
              WHEN event_id % 3 = 1 THEN 'Runtime Error'
              ELSE 'Wrong Answer' END AS status,
         CAST(floor(value * 100) AS INTEGER) AS execution_time_ms,
         CAST(1024 + (event_id * 7919) % 62977 AS INTEGER) AS memory_kb,
         '10.10.0.' || (11 + event_id % 5) AS client_ip,
         CAST(floor(1704067200 + event_id * 0.5) AS BIGINT) AS second
  FROM events)"""

_METRICS = """
metrics AS (
  SELECT 'm1_' || event_id AS metric_id, 'user_' || user_id AS user_id,
         'submission_interval_sec' AS metric_type, CAST(5 + event_id % 30 AS DOUBLE) AS value,
         CAST(1704067200 + event_id * 0.5 AS DOUBLE) AS "timestamp"
  FROM events
  UNION ALL
  SELECT 'm2_' || event_id, 'user_' || user_id,
         CASE WHEN event_id % 2 = 0 THEN 'execution_time_ms' ELSE 'memory_kb' END,
         CAST(CASE WHEN event_id % 2 = 0 THEN floor(value * 100)
                   ELSE 1024 + (event_id * 7919) % 62977 END AS DOUBLE),
         CAST(1704067200 + event_id * 0.5 AS DOUBLE)
  FROM events)"""

_USERS = """
users AS (
  SELECT 'user_' || c_custkey AS user_id, c_name AS full_name, c_mktsegment AS class_cohort
  FROM customer)"""

_PROBLEMS = """
problems AS (
  SELECT 'prob_' || p_partkey AS problem_id, p_name AS title, p_type AS category,
         CASE WHEN s_suppkey IS NOT NULL THEN 'inst_' || s_suppkey END AS instructor_id,
         s_name AS instructor_name
  FROM part LEFT JOIN supplier ON s_suppkey = p_partkey // 20)"""

_LOGIN = """
login AS (
  SELECT user_id, sum(value) / 60.0 AS login_minutes FROM metrics
  WHERE metric_type = 'submission_interval_sec' GROUP BY user_id)"""

_FEATURES = f"""
features AS (
  SELECT a.user_id, total_submissions, solved_count, failed_count, avg_exec_ms,
         coalesce(login_minutes, 0.0) AS login_minutes,
         {_half_up("failed_count / total_submissions * 100.0")} AS fail_rate_pct
  FROM (SELECT user_id, count(submission_id) AS total_submissions,
               count(*) FILTER (WHERE status = 'Pass') AS solved_count,
               count(*) FILTER (WHERE status <> 'Pass') AS failed_count,
               avg(execution_time_ms) AS avg_exec_ms
        FROM submissions GROUP BY user_id) AS a
  LEFT JOIN login ON login.user_id = a.user_id)"""

_ENGAGEMENT = """
engagement AS (
  SELECT user_id, CAST(round(login_minutes * 4.0 + solved_count * 18.0) AS BIGINT) AS engagement_score
  FROM features)"""

_TIERS = """
tiers AS (
  SELECT user_id,
         CASE WHEN solved_count < 12 OR fail_rate_pct >= 65 THEN 'NOVICE'
              WHEN solved_count < 35 OR fail_rate_pct >= 35 THEN 'INTERMEDIATE'
              ELSE 'EXPERT' END AS performance_tier
  FROM features)"""

_DIFFICULTY = """CASE performance_tier WHEN 'NOVICE' THEN 'Easy' WHEN 'INTERMEDIATE' THEN 'Medium'
            ELSE 'Hard' END"""

_LABELS = """
labels_of_users AS (
  SELECT user_id, CASE WHEN fail_rate_pct >= 65 AND login_minutes < 35 AND solved_count < 12
                       THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM features)"""

_HEATMAP = f"""
heatmap AS (
  SELECT a.problem_id, total_attempts, failed_attempts,
         {_half_up("failed_attempts / total_attempts * 100.0")} AS fail_rate_pct, category
  FROM (SELECT problem_id, count(submission_id) AS total_attempts,
               count(*) FILTER (WHERE status <> 'Pass') AS failed_attempts
        FROM submissions GROUP BY problem_id) AS a
  LEFT JOIN problems ON problems.problem_id = a.problem_id)"""

_REVENUE = """
revenue AS (
  SELECT o_orderpriority AS plan_type, count(o_orderpriority) AS total_subscriptions,
         CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_revenue_usd
  FROM orders GROUP BY o_orderpriority)"""

_INSTRUCTORS = f"""
instructors AS (
  SELECT instructor_id, instructor_name,
         {_half_up("avg(1 + CAST(l_quantity AS INTEGER) % 5)")} AS avg_rating,
         count(*) AS total_ratings
  FROM lineitem LEFT JOIN problems ON problem_id = 'prob_' || l_partkey
  WHERE instructor_id IS NOT NULL GROUP BY instructor_id, instructor_name)"""

_BOARD = """
board AS (
  SELECT 'Global' AS rank_tier, user_id, count(problem_id) AS total_solved, 'Pass' AS recent_status
  FROM submissions WHERE status = 'Pass' GROUP BY user_id)"""

_WINDOWS = """
windows AS (
  SELECT user_id, make_timestamp(start_second * 1000000) AS window_start,
         make_timestamp((start_second + 30) * 1000000) AS window_end,
         count(submission_id) AS submission_count_30s,
         count(DISTINCT client_ip) AS distinct_ip_count,
         make_timestamp(max(second) * 1000000) AS window_last_event
  FROM (SELECT *, second - second % 10 - unnest([0, 10, 20]) AS start_second FROM submissions)
  GROUP BY user_id, start_second)"""

_LATENCY = """
latency AS (
  SELECT sha256('HIGH_LATENCY|' || metric_id) AS alert_id, 'HIGH_LATENCY' AS alert_type, user_id,
         'Execution latency exceeded 5s: ' || CAST(value AS VARCHAR) || ' ms' AS description,
         make_timestamp(CAST("timestamp" * 1000000 AS BIGINT)) AS triggered_at,
         CAST(NULL AS TIMESTAMP) AS window_start
  FROM metrics WHERE metric_type = 'execution_time_ms' AND value > 5000)"""


def _bursts(where: str = "TRUE") -> str:
    return f"""
bursts AS (
  SELECT sha256('CHEAT_DETECTED|' || user_id || '|' || CAST(epoch(window_start) AS BIGINT)) AS alert_id,
         'CHEAT_DETECTED' AS alert_type, user_id,
         'Window anomaly: submissions_30s=' || submission_count_30s
           || ', distinct_ips=' || distinct_ip_count AS description,
         window_last_event AS triggered_at, window_start
  FROM windows WHERE (submission_count_30s >= 2 OR distinct_ip_count > 1) AND {where})"""


_CLOSED = """window_end <= (SELECT make_timestamp((max(second) - 120) * 1000000) FROM submissions)"""

_MINUTES = """
windows AS (
  SELECT * FROM every_window WHERE submission_count_30s >= 2 OR distinct_ip_count > 1
  QUALIFY row_number() OVER (
    PARTITION BY user_id, date_trunc('minute', window_end - INTERVAL 1 MICROSECOND) ORDER BY window_start) = 1)"""

_ALERTS = """
alerts AS (SELECT * FROM latency UNION ALL SELECT * FROM bursts)"""

_SILVER_COLUMNS = """problem_id, user_id, make_timestamp(second * 1000000) AS "timestamp", submission_id,
       status, execution_time_ms, memory_kb, CAST(make_timestamp(second * 1000000) AS DATE) AS day"""


_MODEL_INPUTS = (
    "total_submissions", "solved_count", "failed_count", "login_minutes", "avg_exec_ms", "fail_rate_pct"
)
_TERMS = f"['intercept', {', '.join(f"'{name}'" for name in _MODEL_INPUTS)}]"


def _fit(rounds: int = 1500) -> str:
    """The regression fitted anew: gradient steps with momentum over scaled inputs, from the labels alone.

    ``fitted`` has the weights ``b`` per standard deviation and the gradient ``g`` at them; the penalty is
    0.05 on all but the intercept.  Users that all carry one label give no row.
    """
    scaled = ", ".join(
        f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0.0 END"
        for c in _MODEL_INPUTS
    )
    size = len(_MODEL_INPUTS) + 1
    zeros = f"[{', '.join(['0.0'] * size)}]::DOUBLE[]"
    terms = f"range(1, {size + 1})"
    gradient = f"""list_transform({terms}, lambda j:
      list_sum(list_transform(range(1, n + 1), lambda k: r[k] * xs[k][j])) / n
      + CASE WHEN j = 1 THEN 0 ELSE 0.05 * ahead[j] END)"""
    return f"""
scaled AS (
  SELECT features.user_id AS user_id, [1.0, {scaled}] AS x, label
  FROM features JOIN labels_of_users USING (user_id)),
whole AS (
  SELECT list(x ORDER BY user_id) AS xs, list(label ORDER BY user_id) AS ys, CAST(count(*) AS BIGINT) AS n
  FROM scaled HAVING count(DISTINCT label) = 2),
steps AS (
  SELECT 0 AS i, {zeros} AS b, {zeros} AS ahead
  UNION ALL
  SELECT i + 1, moved, list_transform({terms}, lambda j: moved[j] + 0.9 * (moved[j] - b[j]))
  FROM (SELECT i, b, list_transform({terms}, lambda j: ahead[j] - 0.5 * g[j]) AS moved
        FROM (SELECT i, b, ahead, {gradient} AS g
              FROM (SELECT i, b, ahead, n, xs, list_transform(range(1, n + 1), lambda k:
                           1 / (1 + exp(-list_dot_product(xs[k], ahead))) - ys[k]) AS r
                    FROM steps, whole WHERE i < {rounds})))),
fitted AS (
  SELECT b, {gradient} AS g
  FROM (SELECT b, b AS ahead, n, xs, list_transform(range(1, n + 1), lambda k:
               1 / (1 + exp(-list_dot_product(xs[k], b))) - ys[k]) AS r
        FROM steps, whole WHERE i = {rounds}))"""


def _with(*parts: str) -> str:
    return "WITH" + ",".join(parts)


def statements() -> dict[str, str]:
    features = _with(_SUBMISSIONS, _METRICS, _LOGIN, _FEATURES)
    heatmap = _with(_SUBMISSIONS, _PROBLEMS, _HEATMAP)
    board = _with(_SUBMISSIONS, _USERS, _BOARD)
    windows = _with(_SUBMISSIONS, _WINDOWS)
    alerts = _with(_SUBMISSIONS, _METRICS, _USERS, _WINDOWS, _LATENCY, _bursts(), _ALERTS)
    closed = _with(_SUBMISSIONS, _METRICS, _WINDOWS, _LATENCY, _bursts(_CLOSED), _ALERTS)
    silver = f"{_with(_SUBMISSIONS)} SELECT {_SILVER_COLUMNS} FROM submissions"
    silver_metrics = f"{_with(_METRICS)} SELECT * FROM metrics"
    solved = f"{board} SELECT * FROM board"
    every_window = f"{windows} SELECT * FROM windows"
    model = _with(_SUBMISSIONS, _METRICS, _LOGIN, _FEATURES, _LABELS, _fit()).replace("WITH", "WITH RECURSIVE", 1)
    minutes = _with(_SUBMISSIONS, _WINDOWS.replace("windows AS", "every_window AS"), _MINUTES)
    minute_over = """date_trunc('minute', window_end - INTERVAL 1 MICROSECOND) + INTERVAL 1 MINUTE
        <= (SELECT make_timestamp((max(second) - 120) * 1000000) FROM submissions)"""
    unknown = _SUBMISSIONS.replace(
        "'10.10.0.' || (11 + event_id % 5)",
        "CASE WHEN event_id % 3 > 0 THEN '10.10.0.' || (11 + event_id % 5) ELSE 'unknown' END",
    )
    # which of four arrivals an event is in, and the windows it still counted in when it came
    arrivals = """
arrivals AS (
  SELECT *, CASE WHEN place < 1 AND CAST(submission_id AS BIGINT) % 5 < 3 THEN 3 WHEN place < 2 THEN 0
                 WHEN place < 3 THEN 1 ELSE 2 END AS part
  FROM (SELECT *, (CAST(submission_id AS BIGINT) - (SELECT min(event_id) FROM events)) * 4
                  / (SELECT max(event_id) - min(event_id) + 1 FROM events) AS place FROM submissions)),
taken AS (
  SELECT a.*, a.second - a.second % 10 - unnest([0, 10, 20]) AS start_second,
         (SELECT max(second) - 120 FROM arrivals AS b WHERE b.part < a.part) AS closed_through
  FROM arrivals AS a),
seen AS (
  SELECT user_id, start_second, count(*) AS n, count(DISTINCT client_ip) AS ips
  FROM taken WHERE closed_through IS NULL OR start_second + 30 > closed_through
  GROUP BY user_id, start_second)"""
    late = f"""{_with(_SUBMISSIONS, _WINDOWS, _bursts(_CLOSED))},{arrivals}
SELECT * FROM bursts WHERE NOT EXISTS (
  SELECT 1 FROM seen WHERE seen.user_id = bursts.user_id
    AND make_timestamp(start_second * 1000000) = window_start
    AND bursts.description = 'Window anomaly: submissions_30s=' || n || ', distinct_ips=' || ips)"""
    risk = f"""{model},{_USERS},{_TIERS},
scored AS (
  SELECT user_id, coalesce((SELECT 1 / (1 + exp(-list_dot_product(x, b))) FROM fitted),
                           CASE WHEN label = 1 THEN 0.8 ELSE 0.2 END) AS p
  FROM scaled)"""
    found = {
        "silver_submissions": silver,
        "silver_metrics": silver_metrics,
        "quarantined_payloads": """
SELECT raw_payload,
       CASE WHEN raw_payload IS NULL OR trim(raw_payload, ' ') = '' THEN 'empty'
            WHEN json_valid(raw_payload) THEN 'no key' ELSE 'not json' END AS reason
FROM (SELECT text AS raw_payload FROM conversations UNION ALL SELECT html FROM pages)""",
        "deduplicated_bronze": silver,
        "latest_by_key": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
           l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
        "metadata_problems": """
SELECT 'prob_' || p_partkey AS problem_id, p_name AS title, p_type AS category,
       list_extract(['Easy', 'Medium', 'Hard'], CAST(p_size % 3 AS INTEGER) + 1) AS difficulty,
       CAST(list_extract([1000, 2000, 5000], CAST(p_size % 3 AS INTEGER) + 1) AS INTEGER) AS time_limit_ms
FROM part""",
        "login_minutes": f"{_with(_METRICS, _LOGIN)} SELECT * FROM login",
        "attempt_totals": f"""{_with(_SUBMISSIONS)}
SELECT user_id, problem_id, CAST(make_timestamp(second * 1000000) AS DATE) AS day,
       count(submission_id) AS submissions,
       count(*) FILTER (WHERE status = 'Pass') AS passes,
       count(*) FILTER (WHERE status <> 'Pass') AS fails,
       CAST(sum(execution_time_ms) AS BIGINT) AS exec_ms_sum,
       count(execution_time_ms) AS exec_ms_rows
FROM submissions GROUP BY user_id, problem_id, day""",
        "user_features": f"{features} SELECT * FROM features",
        "engagement_scores": f"{features},{_ENGAGEMENT} SELECT * FROM engagement",
        "difficulty_heatmap": f"{heatmap} SELECT * FROM heatmap",
        "subscription_revenue": f"{_with(_REVENUE)} SELECT * FROM revenue",
        "instructor_report_card": f"{_with(_PROBLEMS, _INSTRUCTORS)} SELECT * FROM instructors",
        "adaptive_profiles": f"""{features},{_TIERS}
SELECT user_id, performance_tier,
       CASE performance_tier WHEN 'NOVICE' THEN 'Easy' WHEN 'INTERMEDIATE' THEN 'Medium'
            ELSE 'Hard' END AS recommended_difficulty
FROM tiers""",
        "dropout_labels": f"{features},{_LABELS} SELECT * FROM labels_of_users",
        "dropout_class_balance": f"""{features},{_LABELS}
SELECT label, count(*) AS users FROM labels_of_users GROUP BY label""",
        "dropout_constant_fallback": f"""{features},{_LABELS}
SELECT user_id, CASE WHEN label = 1 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS dropout_probability,
       CASE WHEN label = 1 THEN 'HIGH' ELSE 'LOW' END AS risk_label
FROM labels_of_users""",
        "als_interactions": f"""{_with(_SUBMISSIONS)}
SELECT user_id, problem_id, CAST(count(submission_id) AS DOUBLE) AS rating
FROM submissions WHERE status = 'Pass' GROUP BY user_id, problem_id""",
        "live_leaderboard": solved,
        "cohort_leaderboard": f"""{board}
SELECT coalesce(class_cohort, 'Unknown') AS rank_tier, user_id, total_solved, recent_status
FROM board LEFT JOIN users USING (user_id)""",
        "latency_alerts": f"{_with(_METRICS, _LATENCY)} SELECT * FROM latency",
        "cheat_windows": every_window,
        # five addresses in all: the sketch is exact on that domain
        "cheat_windows_approx": every_window,
        "cheat_alerts": f"{_with(_SUBMISSIONS, _WINDOWS, _bursts())} SELECT * FROM bursts",
        "system_alerts": f"{alerts} SELECT * FROM alerts",
        "cheat_alerts_once_a_minute": f"{minutes},{_bursts()} SELECT * FROM bursts",
        "stream_alerts_once_a_minute": f"{minutes},{_bursts(minute_over)} SELECT * FROM bursts",
        "windows_of_unknown_addresses": f"{_with(unknown, _WINDOWS)} SELECT * FROM windows",
        "stream_bronze": silver,
        "stream_bronze_metrics": silver_metrics,
        "stream_leaderboard": solved,
        "stream_alerts": f"{closed} SELECT * FROM alerts",
        "nightly_table_counts": f"""{features},{_PROBLEMS},{_HEATMAP},{_REVENUE},{_INSTRUCTORS}
SELECT 'bronze_submissions' AS table_name, count(*) AS rows FROM events
UNION ALL SELECT 'silver_submissions', count(*) FROM events
UNION ALL SELECT 'gold_engagement_scores', count(*) FROM features
UNION ALL SELECT 'gold_difficulty_heatmap', count(*) FROM heatmap
UNION ALL SELECT 'gold_subscription_revenue', count(*) FROM revenue
UNION ALL SELECT 'gold_instructor_report_card', count(*) FROM instructors
UNION ALL SELECT 'gold_dropout_predictions', count(*) FROM features
UNION ALL SELECT 'gold_next_problem_recommendations', count(DISTINCT user_id) FROM submissions
          WHERE status = 'Pass'
UNION ALL SELECT 'gold_adaptive_difficulty_profiles', count(*) FROM features""",
        "dropout_prediction_checks": f"""{features}
SELECT count(*) AS users, CAST(0 AS BIGINT) AS no_probability, CAST(0 AS BIGINT) AS wrong_band FROM features""",
        "recommendation_checks": f"""{_with(_SUBMISSIONS)}
SELECT count(DISTINCT user_id) AS rows, count(DISTINCT user_id) AS users,
       CAST(0 AS BIGINT) AS unknown_problems, CAST(0 AS BIGINT) AS unrounded
FROM submissions WHERE status = 'Pass'""",
        "dropout_model_weights": f"""{model}
SELECT term, round(b[place], 4) + 0.0 AS weight, round(g[place], 3) + 0.0 AS gradient
FROM fitted, (SELECT unnest({_TERMS}) AS term, unnest(range(1, {len(_MODEL_INPUTS) + 2})) AS place)
WHERE place = 1 OR (SELECT bool_or(x[place] <> 0) FROM scaled)""",
        "dropout_predictions_rounded": f"""{model},
scored AS (
  SELECT user_id, coalesce((SELECT 1 / (1 + exp(-list_dot_product(x, b))) FROM fitted),
                           CASE WHEN label = 1 THEN 0.8 ELSE 0.2 END) AS p
  FROM scaled)
SELECT user_id, round(p, 3) AS dropout_probability,
       CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label
FROM scored""",
        "recommendation_factor_checks": f"""{_with(_SUBMISSIONS)}
SELECT 'users' AS what, count(DISTINCT user_id) AS rows FROM submissions WHERE status = 'Pass'
UNION ALL SELECT 'problems', count(DISTINCT problem_id) FROM submissions WHERE status = 'Pass'
UNION ALL SELECT 'users off the optimum', 0""",
        "unsolved_recommendation_checks": f"""{_with(_SUBMISSIONS)},
passes AS (SELECT DISTINCT user_id, problem_id FROM submissions WHERE status = 'Pass'),
open_to AS (
  SELECT user_id FROM passes GROUP BY user_id
  HAVING count(*) < (SELECT count(DISTINCT problem_id) FROM passes))
SELECT count(*) AS rows, count(*) AS users, CAST(0 AS BIGINT) AS solved_before FROM open_to""",
        "key_number_checks": f"""{_with(_SUBMISSIONS)}
SELECT 'user_id' AS what, count(DISTINCT user_id) AS keys, count(DISTINCT user_id) AS numbers,
       CAST(0 AS BIGINT) AS misplaced FROM submissions
UNION ALL SELECT 'problem_id', count(DISTINCT problem_id), count(DISTINCT problem_id), 0 FROM submissions""",
        "srv_risk_board_by_rate": f"""{features},{_USERS},{_TIERS}
SELECT features.user_id AS user_id, full_name, class_cohort,
       {_half_up("fail_rate_pct / 100 * 100")} AS dropout_probability,
       CASE WHEN fail_rate_pct / 100 >= 0.7 THEN 'HIGH' WHEN fail_rate_pct / 100 >= 0.45 THEN 'MEDIUM'
            ELSE 'LOW' END AS risk_label,
       performance_tier, {_DIFFICULTY} AS recommended_difficulty
FROM features JOIN tiers USING (user_id) LEFT JOIN users ON users.user_id = features.user_id""",
        "srv_recommendation_board_by_passes": f"""{features},{_USERS},{_TIERS},
passes AS (SELECT user_id, problem_id, count(*) AS n FROM submissions WHERE status = 'Pass' GROUP BY ALL),
chosen AS (
  SELECT user_id, problem_id AS recommended_problem_id, CAST(n AS DOUBLE) AS recommendation_score
  FROM passes
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, problem_id DESC) = 1
  ORDER BY recommendation_score DESC, user_id LIMIT 100)
SELECT chosen.*, full_name, class_cohort, p_name AS title,
       list_extract(['Easy', 'Medium', 'Hard'], CAST(p_size % 3 AS INTEGER) + 1) AS difficulty,
       performance_tier, {_DIFFICULTY} AS recommended_difficulty
FROM chosen JOIN tiers USING (user_id) LEFT JOIN users ON users.user_id = chosen.user_id
LEFT JOIN part ON 'prob_' || p_partkey = recommended_problem_id""",
        "srv_leaderboard_top10": f"""{board}
SELECT user_id, rank_tier, total_solved, recent_status, full_name, class_cohort
FROM board LEFT JOIN users USING (user_id) ORDER BY total_solved DESC, user_id LIMIT 10""",
        "srv_leaderboard_age": f"""{board},
last_pass AS (SELECT user_id, max(second) AS second FROM submissions WHERE status = 'Pass' GROUP BY user_id),
aged AS (
  SELECT board.*, make_timestamp(second * 1000000) AS last_updated,
         epoch(TIMESTAMP '2024-01-02 00:00:00') - second AS seconds
  FROM board JOIN last_pass USING (user_id))
SELECT user_id, rank_tier, total_solved, recent_status, last_updated, full_name, class_cohort,
       CASE WHEN seconds < 60 THEN 'Just now'
            WHEN seconds < 3600 THEN CAST(floor(seconds / 60) AS BIGINT) || ' mins ago'
            WHEN seconds < 86400 THEN CAST(floor(seconds / 3600) AS BIGINT) || ' hours ago'
            ELSE CAST(floor(seconds / 86400) AS BIGINT) || ' days ago' END AS age
FROM aged LEFT JOIN users USING (user_id) ORDER BY total_solved DESC, user_id LIMIT 10""",
        "late_alerts": late,
        "fresh_start_counts": f"""{board}
SELECT 'bronze_submissions' AS table_name, 2 * count(*) AS rows FROM events
UNION ALL SELECT 'gold_live_leaderboard', count(*) FROM board
UNION ALL SELECT 'gold_system_alerts', 0""",
        "alerts_without_a_time": f"""{_with(_METRICS, _LATENCY)}
SELECT count(*) AS rows, count(*) AS timed FROM latency""",
        "stored_update_times": f"""{features},{_PROBLEMS},{_HEATMAP},{_REVENUE},{_INSTRUCTORS},
counted AS (
  SELECT 'gold_engagement_scores' AS table_name, count(*) AS rows FROM features
  UNION ALL SELECT 'gold_difficulty_heatmap', count(*) FROM heatmap
  UNION ALL SELECT 'gold_subscription_revenue', count(*) FROM revenue
  UNION ALL SELECT 'gold_instructor_report_card', count(*) FROM instructors
  UNION ALL SELECT 'gold_dropout_predictions', count(*) FROM features
  UNION ALL SELECT 'gold_next_problem_recommendations', count(DISTINCT user_id) FROM submissions WHERE status = 'Pass'
  UNION ALL SELECT 'gold_adaptive_difficulty_profiles', count(*) FROM features)
SELECT table_name, rows, rows AS stamped FROM counted""",
        "stored_alert_feed": f"""{closed},{_USERS}
SELECT alert_id, triggered_at, alert_type, coalesce(full_name, alerts.user_id) AS full_name,
       coalesce(class_cohort, 'Unknown') AS class_cohort, description
FROM alerts LEFT JOIN users ON users.user_id = alerts.user_id
ORDER BY triggered_at DESC, alert_id LIMIT 50""",
        "stored_alert_counts": f"""{closed}
SELECT count(*) FILTER (WHERE alert_type = 'HIGH_LATENCY') AS high_latency,
       count(*) FILTER (WHERE alert_type = 'CHEAT_DETECTED') AS cheat_detected
FROM alerts""",
        "srv_risk_board": f"""{risk}
SELECT scored.user_id AS user_id, full_name, class_cohort, {_half_up("p * 100")} AS dropout_probability,
       CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label,
       performance_tier, {_DIFFICULTY} AS recommended_difficulty
FROM scored JOIN tiers USING (user_id) LEFT JOIN users ON users.user_id = scored.user_id""",
        "srv_leaderboard_kpis": f"""{board}
SELECT (SELECT full_name FROM board LEFT JOIN users USING (user_id)
        ORDER BY total_solved DESC, user_id LIMIT 1) AS top_student,
       count(DISTINCT user_id) AS active_users, CAST(sum(total_solved) AS BIGINT) AS total_solved
FROM board""",
        "srv_quick_stats": f"""{features},{_PROBLEMS},{_HEATMAP},{_BOARD},{_ENGAGEMENT}
SELECT (SELECT count(DISTINCT user_id) FROM board) AS active_users,
       (SELECT CAST(sum(total_solved) AS BIGINT) FROM board) AS total_solved,
       (SELECT {_half_up("avg(fail_rate_pct)")} FROM heatmap) AS avg_fail_rate,
       (SELECT count(*) FROM engagement WHERE engagement_score < 100) AS low_engagement_users""",
        "srv_heatmap_top12": f"""{heatmap}
SELECT heatmap.*, title FROM heatmap LEFT JOIN problems USING (problem_id)
ORDER BY fail_rate_pct DESC, heatmap.problem_id LIMIT 12""",
        "srv_failure_rollup": f"""{heatmap}
SELECT heatmap.category AS category, title, CAST(grouping(heatmap.category, title) AS BIGINT) AS level,
       CAST(sum(failed_attempts) AS BIGINT) AS failed_attempts
FROM heatmap LEFT JOIN problems USING (problem_id)
GROUP BY ROLLUP (heatmap.category, title)""",
        "srv_failure_share": f"""{heatmap}
SELECT category, CAST(sum(failed_attempts) AS BIGINT) AS failed_attempts,
       {_half_up("sum(failed_attempts) / (SELECT sum(failed_attempts) FROM heatmap) * 100.0")} AS share_pct
FROM heatmap GROUP BY category""",
        "srv_revenue": f"{_with(_REVENUE)} SELECT * FROM revenue ORDER BY total_revenue_usd DESC, plan_type",
        "srv_revenue_totals": f"""{_with(_REVENUE)}
SELECT CAST(sum(CAST(total_revenue_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue_usd,
       CAST(sum(total_subscriptions) AS BIGINT) AS total_subscriptions
FROM revenue""",
        "srv_instructors": f"""{_with(_PROBLEMS, _INSTRUCTORS)}
SELECT * FROM instructors ORDER BY avg_rating DESC, instructor_id""",
        "srv_tier_distribution": f"""{features},{_TIERS}
SELECT performance_tier AS tier, count(*) AS users FROM tiers
WHERE user_id IN (SELECT user_id FROM submissions WHERE status = 'Pass') GROUP BY performance_tier""",
        "srv_alert_feed": f"""{alerts}
SELECT alert_id, triggered_at, alert_type, coalesce(full_name, alerts.user_id) AS full_name,
       coalesce(class_cohort, 'Unknown') AS class_cohort, description
FROM alerts LEFT JOIN users ON users.user_id = alerts.user_id
ORDER BY triggered_at DESC, alert_id LIMIT 50""",
        "srv_alert_counts": f"""{alerts}
SELECT count(*) FILTER (WHERE alert_type = 'HIGH_LATENCY') AS high_latency,
       count(*) FILTER (WHERE alert_type = 'CHEAT_DETECTED') AS cheat_detected
FROM alerts""",
        "relative_age": """
SELECT CAST(event_id AS VARCHAR) AS submission_id,
       CASE WHEN age < 60000000 THEN 'Just now'
            WHEN age < 3600000000 THEN (age // 60000000) || ' mins ago'
            WHEN age < 86400000000 THEN (age // 3600000000) || ' hours ago'
            ELSE (age // 86400000000) || ' days ago' END AS age
FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts) AS age FROM events)""",
    }
    # what was stored, and what came in three nights, has the SQL of what is computed at once
    same = {
        "nightly_engagement_scores": "engagement_scores",
        "nightly_difficulty_heatmap": "difficulty_heatmap",
        "nightly_subscription_revenue": "subscription_revenue",
        "nightly_instructor_report_card": "instructor_report_card",
        "nightly_adaptive_profiles": "adaptive_profiles",
        "stored_heatmap_board": "srv_heatmap_top12",
        "stored_failure_rollup": "srv_failure_rollup",
        "stored_instructor_board": "srv_instructors",
        "stored_failure_share": "srv_failure_share",
        "stored_risk_board": "srv_risk_board",
        "stored_revenue_board": "srv_revenue",
        "stored_revenue_totals": "srv_revenue_totals",
        "stored_leaderboard": "srv_leaderboard_top10",
        "stored_leaderboard_kpis": "srv_leaderboard_kpis",
        "stored_quick_stats": "srv_quick_stats",
        "stored_tier_distribution": "srv_tier_distribution",
        "stream_cheat_alerts_approx": "stream_alerts",
        "stream_from_topic_files": "silver_submissions",
        "restarted_leaderboard": "stream_leaderboard",
        "restarted_alerts": "stream_alerts",
        "incremental_submissions": "silver_submissions",
        "incremental_metrics": "silver_metrics",
        "incremental_features": "user_features",
    }
    return found | {name: found[other] for name, other in same.items()}
