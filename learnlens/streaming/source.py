"""Message streams: a Kafka topic, or files that stand for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from learnlens.config import Settings


def kafka_options(settings: Settings, topic: str) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": settings.kafka_bootstrap,
        "subscribe": topic,
        "startingOffsets": settings.starting_offsets,
        "failOnDataLoss": str(settings.fail_on_data_loss).lower(),
    }
    if settings.max_offsets_per_trigger > 0:  # zero: no cap
        options["maxOffsetsPerTrigger"] = str(settings.max_offsets_per_trigger)
    return options


def event_source(spark: SparkSession, settings: Settings, topic: str) -> DataFrame:
    """An unbounded frame whose ``value`` column holds the messages of ``topic``.

    ``files``: ``<source_path>/<topic>/`` with one message per line (``text``) or per row
    (``parquet``, column ``value``).
    """
    if settings.source_kind == "kafka":
        reader = spark.readStream.format("kafka").options(**kafka_options(settings, topic))
        return reader.load().select("value")
    if settings.source_kind == "files":
        if not settings.source_path:
            raise ValueError("source_kind 'files' needs a source_path")
        reader = spark.readStream.format(settings.source_format).schema("value string")
        if settings.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", settings.max_files_per_trigger)
        return reader.load(f"{settings.source_path.rstrip('/')}/{topic}")
    raise ValueError(f"unknown source kind: {settings.source_kind}")
