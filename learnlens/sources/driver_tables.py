"""The given Parquet tables seen as the telemetry model.

Each ``events`` row is one submission and two metrics; customers are users, parts problems,
suppliers instructors, orders transactions and line items ratings.  Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens import schemas
from learnlens.functions import times

# Fixed values of the mapping.
_FIRST_SECOND = 1704067200.0  # 2024-01-01T00:00:00Z
_SECONDS_PER_EVENT = 0.5
_DIFFICULTIES = ("Easy", "Medium", "Hard")
_TIME_LIMITS_MS = (1000, 2000, 5000)
_PROBLEMS_PER_INSTRUCTOR = 20


def _key(prefix: str, number: Column | str) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit(prefix), number.cast("string"))


class DriverTables:
    """Lazy frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def state(self) -> tuple:
        """Names, sizes and times of change of the tables: other files give another state."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.GIVEN[name]).parquet(self.path(name))

    # events ---------------------------------------------------------------------------

    def event_stream(self) -> DataFrame:
        """The ``events`` table as a file stream; the pattern takes one file or a folder of them."""
        reader = self.spark.readStream.schema(schemas.GIVEN["events"])
        return reader.parquet(self.path("events") + "*")

    def submissions(self) -> DataFrame:
        """Typed submissions, as the parser gives them."""
        epoch = F.col("timestamp")
        return submission_fields(self.table("events")).withColumns(
            {"timestamp": times.whole_second(epoch), "day": times.utc_day(epoch)}
        )

    def metrics(self) -> DataFrame:
        return metric_fields(self.table("events"))

    def submission_messages(self, events: DataFrame | None = None) -> DataFrame:
        return _messages(submission_fields(self.table("events") if events is None else events))

    def metric_messages(self, events: DataFrame | None = None) -> DataFrame:
        return _messages(metric_fields(self.table("events") if events is None else events))

    # metadata -------------------------------------------------------------------------

    def users(self) -> DataFrame:
        return self.table("customer").select(
            _key("user_", "c_custkey").alias("user_id"),
            F.col("c_name").alias("full_name"),
            F.col("c_mktsegment").alias("class_cohort"),
        )

    def problems(self) -> DataFrame:
        level = F.col("p_size") % 3
        return self._catalogue().select(
            _key("prob_", "p_partkey").alias("problem_id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("category"),
            F.element_at(F.array(*map(F.lit, _DIFFICULTIES)), level + 1).alias("difficulty"),
            F.element_at(F.array(*map(F.lit, _TIME_LIMITS_MS)), level + 1).alias("time_limit_ms"),
        )

    def taught_problems(self) -> DataFrame:
        """Problems with their instructor, where there is one."""
        instructors = (
            self.table("supplier").select(
                "s_suppkey",
                _key("inst_", "s_suppkey").alias("instructor_id"),
                F.col("s_name").alias("instructor_name"),
            )
        )
        taught_by = F.floor(F.col("p_partkey") / _PROBLEMS_PER_INSTRUCTOR)
        return (
            self._catalogue()
            .select(_key("prob_", "p_partkey").alias("problem_id"), "p_type", taught_by.alias("s_suppkey"))
            .join(instructors, "s_suppkey", "left")
            .select("problem_id", F.col("p_type").alias("category"), "instructor_id", "instructor_name")
        )

    def _catalogue(self) -> DataFrame:
        return self.table("part")

    def transactions(self) -> DataFrame:
        return self.table("orders").select(
            _key("txn_", "o_orderkey").alias("transaction_id"),
            _key("user_", "o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("plan_type"),
            F.col("o_totalprice").alias("amount_usd"),
            F.col("o_orderdate").cast("timestamp").alias("date"),
        )

    def ratings(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat_ws("_", F.lit("rating"), "l_orderkey", "l_linenumber").alias("rating_id"),
            _key("prob_", "l_partkey").alias("problem_id"),
            _key("user_", "l_suppkey").alias("user_id"),
            (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("rating_score"),
            F.col("l_returnflag").alias("feedback"),
        )


def submission_fields(events: DataFrame) -> DataFrame:
    number = F.col("event_id")
    return events.select(
        number.cast("string").alias("submission_id"),
        _key("user_", "user_id").alias("user_id"),
        _key("prob_", F.get_json_object("props", "$.k")).alias("problem_id"),
        F.when(F.col("value") < 10 + 12 * (F.col("user_id") % 10), "Pass")
        .when(number % 3 == 0, "Time Limit Exceeded")
        .when(number % 3 == 1, "Runtime Error")
        .otherwise("Wrong Answer")
        .alias("status"),
        _exec_ms().alias("execution_time_ms"),
        _memory_kb().alias("memory_kb"),
        _key("10.10.0.", 11 + number % 5).alias("client_ip"),
        _epoch().alias("timestamp"),
    )


def metric_fields(events: DataFrame) -> DataFrame:
    """Two metrics per event from one scan: the interval, and run time or memory in turn."""
    number = F.col("event_id")
    timed = number % 2 == 0
    interval = F.struct(
        _key("m1_", number).alias("metric_id"),
        F.lit("submission_interval_sec").alias("metric_type"),
        (5 + number % 30).cast("double").alias("value"),
    )
    usage = F.struct(
        _key("m2_", number).alias("metric_id"),
        F.when(timed, "execution_time_ms").otherwise("memory_kb").alias("metric_type"),
        F.when(timed, _exec_ms()).otherwise(_memory_kb()).cast("double").alias("value"),
    )
    return events.select(
        _key("user_", "user_id").alias("user_id"),
        _epoch().alias("timestamp"),
        F.inline(F.array(interval, usage)),
    ).select("metric_id", "user_id", "metric_type", "value", "timestamp")


def _exec_ms() -> Column:
    return F.floor(F.col("value") * 100).cast("int")


def _memory_kb() -> Column:
    return (1024 + (F.col("event_id") * 7919) % 62977).cast("int")


def _epoch() -> Column:
    return F.lit(_FIRST_SECOND) + F.col("event_id") * F.lit(_SECONDS_PER_EVENT)


def _messages(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).cast("binary").alias("value"))
