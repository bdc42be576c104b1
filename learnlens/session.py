"""Spark sessions and the shared folder that survives executor loss."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from learnlens.config import Settings


def build_session(app_name: str = "learnlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def stream_session(spark: SparkSession, settings: Settings) -> SparkSession:
    """A sibling session with the stream options; the caller's session stays as it is.

    State is kept in RocksDB because the leaderboard holds one row per user for ever.  The
    shuffle width is frozen into a checkpoint at its first start.
    """
    session = spark.newSession()
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(settings.stream_shuffle_partitions),
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # the count costs a look-up for every row that is written
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": str(settings.count_state_rows).lower(),
    }.items():
        session.conf.set(key, value)
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or else what was given to
    ``setCheckpointDir``.  There is no default."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    raise ValueError("spark.checkpoint.dir must name a folder shared by the whole cluster")


_JOB_FOLDER: ContextVar[str | None] = ContextVar("job_folder", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path (not created yet) below the shared folder, or below that of the job."""
    root = _JOB_FOLDER.get() or f"{shared_dir(spark)}/learnlens"
    return f"{root}/{label}-{uuid.uuid4().hex}"


@contextmanager
def job_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """What is staged inside goes to one folder, which is removed at the end, failed or not.

    Nothing that is read later may depend on staged tables: store it inside.
    """
    folder = new_folder(spark, label)
    outer = _JOB_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _JOB_FOLDER.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: later passes (model iterations, several joins) re-read a table rather
    than repeat the work above it, also after executors are lost.  The file sizes tell the
    planner whether a side is small enough to broadcast.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
