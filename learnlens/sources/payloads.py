"""JSON messages to typed columns, the same way in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from learnlens import schemas
from learnlens.functions import times


def decode(messages: DataFrame) -> DataFrame:
    """Message value (binary or text) to ``raw_payload`` text."""
    return messages.select(F.col("value").cast("string").alias("raw_payload"))


def parse(raw: DataFrame, schema: StructType, *keep: str) -> DataFrame:
    """The fields of ``schema`` found in ``raw_payload``; ``keep`` names other columns to carry.

    Unreadable text gives null fields.  Name only the fields that are needed.  The struct is
    unpacked by a generator because filters are not pushed through one: pushed below a plain
    projection, every filter on a parsed field would parse the text once more.
    """
    return raw.select(*keep, F.inline(F.array(F.from_json("raw_payload", schema))))


def submissions(raw: DataFrame, *keep: str) -> DataFrame:
    """Typed submissions with event time cut to the second and its UTC day."""
    epoch = F.col("timestamp")
    return parse(raw, schemas.SUBMISSION, *keep).withColumns(
        {"timestamp": times.whole_second(epoch), "day": times.utc_day(epoch)}
    )


def metrics(raw: DataFrame, *keep: str) -> DataFrame:
    """Typed metrics of known users; ``timestamp`` stays in epoch seconds."""
    return parse(raw, schemas.METRIC, *keep).filter(F.col("user_id").isNotNull())


def rejection(raw_payload: Column) -> Column:
    """Why a message without a key was not taken."""
    return (
        F.when(raw_payload.isNull() | (F.trim(raw_payload) == ""), "empty")
        .when(F.try_parse_json(raw_payload).isNull(), "not json")
        .otherwise("no key")
    )


def keyed(raw: DataFrame, schema: StructType, key: str) -> DataFrame:
    """``raw_payload`` with its key and, where there is none, the reason."""
    return parse(raw, schemas.fields_of(schema, key), "raw_payload").select(
        key,
        "raw_payload",
        F.when(F.col(key).isNull(), rejection(F.col("raw_payload"))).alias("reason"),
    )


def quarantine(raw: DataFrame, schema: StructType, key: str) -> DataFrame:
    """The dead letters: messages that carry no key, with the reason."""
    return keyed(raw, schema, key).filter(F.col(key).isNull()).select("raw_payload", "reason")


def bronze(raw: DataFrame, schema: StructType, key: str) -> DataFrame:
    """Rows of a bronze table.  Nothing is dropped: dead letters go to ``accepted = false``."""
    return (
        keyed(raw, schema, key)
        .withColumn("ingest_timestamp", F.current_timestamp())
        .select(
            key,
            "ingest_timestamp",
            "raw_payload",
            "reason",
            F.to_date("ingest_timestamp").alias("ingest_day"),
            F.col(key).isNotNull().alias("accepted"),
        )
    )
