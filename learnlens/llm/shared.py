"""Helpers of the operators: scratch folders, byte arrays, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from pathlib import Path
from threading import local

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.session import new_folder

# The white space of the contracts: space, and tab to carriage return.  Fixed values.
BLANKS = r"[\x20\x09-\x0D]"


def _findable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, unless it is installed."""
    environment = spark.sparkContext.environment
    here = str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])


class Scratch:
    """A folder of written tables below ``spark.checkpoint.dir``.

    A staged table cuts the lineage: what follows re-reads files that all executors share, so
    a lost executor costs only the step it was in.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = new_folder(spark, label)
        self.times: dict[str, int] = {}
        _findable(spark)

    def path(self, name: str) -> str:
        """The last folder of this name."""
        return f"{self.root}/{name}-{self.times.get(name, 0)}"

    def fresh(self, name: str) -> str:
        """A new folder of this name."""
        self.times[name] = self.times.get(name, 0) + 1
        return self.path(name)

    def stage(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(self.fresh(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, by: Sequence[str] = ()) -> DataFrame:
        """A staged table whose rows are dealt to buckets by ``key``: grouping or joining by it
        reads the table where it lies, without a shuffle."""
        table = f"learnlens_{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd").option("path", self.fresh(name)).bucketBy(buckets, key)
        (writer.partitionBy(*by) if by else writer).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions: how finely work is cut.  Results never depend on it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, number: int) -> list[int]:
    """Numbers of which a shuffle by hash into ``number`` partitions deals one to each."""
    partition = F.pmod(F.hash("id"), F.lit(number)).alias("partition")
    found: list[int] = []
    reach = 16 * number
    while len(found) < number:
        rows = spark.range(reach).groupBy(partition).agg(F.min("id").alias("id")).collect()  # ``number`` rows
        found, reach = sorted(row["id"] for row in rows), 2 * reach
    return found


_CODEC = local()


def squeezed(raw: bytes) -> bytes:
    if not hasattr(_CODEC, "squeeze"):
        _CODEC.squeeze = zstandard.ZstdCompressor(level=3).compress
    return _CODEC.squeeze(raw)


def expanded(raw) -> bytes:
    if not hasattr(_CODEC, "expand"):
        _CODEC.expand = zstandard.ZstdDecompressor().decompress
    return _CODEC.expand(raw)


def packed(numbers) -> bytes:
    """Integers below 2**32, compressed: a byte each, and byte planes of what is beyond."""
    whole = np.ascontiguousarray(numbers, dtype="<u4")
    rest = np.ascontiguousarray(whole[whole >= 255] - np.uint32(255))
    planes = rest.view(np.uint8).reshape(-1, 4).T
    count = np.array([len(whole)], "<u8")
    return squeezed(count.tobytes() + np.minimum(whole, 255).astype(np.uint8).tobytes() + planes.tobytes())


def unpacked(raw) -> np.ndarray:
    raw = expanded(raw)
    count = int(np.frombuffer(raw, "<u8", 1)[0])
    whole = np.frombuffer(raw, np.uint8, count, 8).astype("<u4")
    planes = np.frombuffer(raw, np.uint8, offset=8 + count).reshape(4, -1).T
    whole[whole == 255] += np.ascontiguousarray(planes).view("<u4").ravel()
    return whole


def cut(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    """The pieces of a squeezed blob that have these lengths."""
    blob = expanded(blob)
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    starts = [0, *ends[:-1]]
    return [blob[a:b] for a, b in zip(starts, ends, strict=True)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches, binary columns as buffers and not copied."""
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(names, columns, strict=True):
                value = column[i]
                if not value.is_valid:
                    row[name] = None
                else:
                    row[name] = value.as_buffer() if pa.types.is_binary(value.type) else value.as_py()
            yield row


def text_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def components(links: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that is reachable, for every node with a link.

    Alternates large-star and small-star steps until nothing changes.  Each is an aggregate and
    a join keyed by node, so no component meets in one task; links stay on the executors.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    ordered = links.select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).filter("u <> v")
    edges = scratch.stage(ordered.distinct(), "edges-0")
    before, turn = None, 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(smallest(both), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        own = smallest(large)
        small = large.join(own, "u").filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(own.select("u", F.col("m").alias("v")))
        edges = scratch.stage(small.filter("u <> v").distinct(), f"edges-{turn}")
        # the sum of hashes tells whether the set of edges has changed
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
