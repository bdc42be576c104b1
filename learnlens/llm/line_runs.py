"""Line dedup over levelled, sorted runs of line hashes.

The store of known lines is a set of runs.  A run is a bucketed table of ``(key, owner)``, one file
per bucket, sorted by key and never changed.  A batch of documents is merge-anti-joined with every run;
what is left are the lines seen for the first time, which become a new run of level 0.  When a level
holds ``fanout`` runs they are merged into one run of the next level, so a store of n batches has at most
``fanout * log(n)`` runs.
Lines are dealt to buckets once; batches, anti-joins, merges and the last look-up read bucket by bucket, in
order, without a shuffle and without sorting a run again.  A run that was merged is dropped, with its files.

Batches must come in ascending document order: a line belongs to the smallest document that
holds it, so the first batch that holds a line owns it.

A line that very many documents hold would fill one bucket: lines with more than a ``1 / (HOT * buckets)``
share of all are at most ``HOT * buckets`` in number.  These are broadcast with their owners, and their
occurrences stay where they are; the store gets one row of each.

Defined results: a null or empty text is one empty line; a line whose key (stripped, A-Z in
lower case) has under ``min_chars`` code points always stays; a null doc_id counts as the
smallest of all, and rows with equal doc_ids are one document for ownership; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.llm.shared import Scratch, free_name, text_rows, union_all, width

NO_ID = -(2**63)


def line_key(line: bytes) -> bytes:
    # bytes: strip() and lower() then know the ASCII blanks and letters only
    return line.strip().lower()


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the key, equal hashes are taken for equal lines; None for a short key."""
    key = line_key(line)
    if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _in_order(spark: SparkSession, buckets: int) -> SparkSession:
    """A sibling session that uses the order of bucketed tables; the caller's options stay as they are."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(buckets),  # a shuffle by key deals to buckets
    }.items():
        session.conf.set(key, value)
    return session


class LineRuns:
    """The runs.  ``buckets`` is fixed for the life of a store: a bucket of a run is the unit a task
    merges, so take as many as the tasks of a shuffle over the lines."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32, fanout: int = 2):
        self.spark, self.root, self.buckets, self.fanout = _in_order(spark, buckets), root, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def store(self, rows: DataFrame, by: tuple[str, ...] = ()) -> str:
        """Write rows whose tasks hold whole buckets: one sorted file per bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{self.root}/{name}"
        writer = rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self.paths[name])
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        return name

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Each bucket in one task: a shuffle by key and buckets hash alike."""
        return rows.repartition(self.buckets, "key")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        """Remove a table from the catalog, and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (a row per key) that no run has."""
        for run in self.runs():
            batch = batch.join(self.table(run).select("key").hint("merge"), "key", "left_anti")
        return batch

    def merged(self, one: str, other: str) -> DataFrame:
        """The rows of two runs, which share no key."""
        left, right = self.table(one), self.table(other).withColumnRenamed("owner", "other")
        both = left.hint("merge").join(right, "key", "full")
        return both.select("key", F.coalesce("owner", "other").alias("owner"))

    def _merge(self, one: str, other: str) -> str:
        made = self.store(self.merged(one, other))
        self.drop(one)
        self.drop(other)
        return made

    def ingest(self, batch: DataFrame) -> None:
        """Add the keys of ``(key, owner)`` that are new, then compact full levels."""
        first = batch.groupBy("key").agg(F.min("owner").alias("owner"))
        added, level = self.store(self.unseen(first)), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(added)
            if len(self.levels[level]) < self.fanout:
                return
            added = reduce(self._merge, self.levels[level])
            self.levels[level], level = [], level + 1

    def compact(self) -> str | None:
        """Merge all runs, the smallest first; the name of the one that is left."""
        runs = self.runs()
        self.levels = [[reduce(self._merge, runs)]] if runs else []
        return self.levels[0][0] if runs else None

    def owners(self) -> DataFrame:
        return union_all([self.table(run).select("key", "owner") for run in self.runs()])

    def remove(self) -> None:
        """Drop all that is left."""
        for name in list(self.paths):
            self.drop(name)
        self.levels = []


def _batch_edges(documents: DataFrame, batches: int) -> list[int]:
    """Document ids that cut the table into batches; only where batches begin hangs on them."""
    shares = [i / batches for i in range(1, batches)]
    edges = documents.select(F.percentile_approx("doc_id", shares, 1000).alias("e")).first()["e"]
    return sorted(set(edges or []))


HOT = 4  # common lines for each bucket, at most


def deduplicate(
    documents: DataFrame,
    scratch: Scratch,
    min_chars: int = 10,
    batches: int = 4,
    buckets: int | None = None,
    fanout: int = 2,
) -> DataFrame:
    """``documents`` with ``kept_text``, ``n_lines`` and ``n_dropped``; all columns stay."""
    spark = documents.sparkSession
    edges = _batch_edges(documents, batches)
    batch = F.lit(0)
    for edge in edges:
        batch = batch + F.when(F.col("owner") >= edge, 1).otherwise(0)

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("owner", pa.int64()), ("mark", pa.int64()), ("key", pa.binary())])
        rows: list[tuple] = []

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for owner, mark, text in text_rows(parts, "owner", "mark", "text"):
            own = {key_hash(line, min_chars) for line in (text or "").encode().split(b"\n")}
            own.discard(None)
            rows.extend((owner, mark, key) for key in own)
            if len(rows) > 100_000:
                yield taken()
        yield taken()

    # a text is known by its document and a hash, so rows without an id are not gathered
    owner, mark = F.coalesce("doc_id", F.lit(NO_ID)).alias("owner"), F.xxhash64("text").alias("mark")
    lines = documents.select(owner, mark, "text").mapInArrow(hashes, "owner long, mark long, key binary")
    scratch.stage(lines, "lines")

    store = LineRuns(spark, scratch.path("runs"), buckets or width(spark), fanout)
    lines = store.spark.read.schema(lines.schema).parquet(scratch.path("lines"))
    most = max(1, lines.count() // (HOT * store.buckets))
    held = lines.groupBy("key").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
    scratch.stage(held.filter(F.col("n") > most).select("key", "owner"), "hot")
    hot = store.spark.read.schema("key binary, owner long").parquet(scratch.path("hot"))

    once = hot.select("owner", F.lit(None).cast("long").alias("mark"), "key")
    cold = lines.join(F.broadcast(hot.select("key")), "key", "left_anti").select("owner", "mark", "key")
    dealt = store.dealt(cold.unionByName(once)).withColumn("batch", batch)
    dealt = store.store(dealt, by=("batch",))

    for number in range(len(edges) + 1):
        store.ingest(store.table(dealt).filter(F.col("batch") == number).select("key", "owner"))
    run = store.compact()

    # a line is dropped where its document is not the one that owns it
    gone = union_all([owned(store, dealt, run), common(lines, hot)])
    gone = gone.groupBy("owner", "mark").agg(F.collect_set("key").alias("gone"))  # of one text
    scratch.stage(gone, "gone")
    store.remove()
    scratch.drop("lines")

    own_id, own_mark, own_gone = (free_name(documents, n) for n in ("owner", "mark", "gone"))
    gone = spark.read.schema(gone.schema).parquet(scratch.path("gone")).toDF(own_id, own_mark, own_gone)

    @F.pandas_udf("kept_text string, n_lines long, n_dropped long")
    def rebuilt(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, drop in zip(texts, gone, strict=True):
            lines = (text or "").encode().split(b"\n")
            if drop is None or len(drop) == 0:
                rows.append((text or "", len(lines), 0))
                continue
            drop = set(drop)
            kept = [line for line in lines if key_hash(line, min_chars) not in drop]
            rows.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["kept_text", "n_lines", "n_dropped"])

    result = free_name(documents, "result")
    others = [c for c in documents.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    same = (F.coalesce(documents["doc_id"], F.lit(NO_ID)) == F.col(own_id)) & (
        F.xxhash64(documents["text"]) == F.col(own_mark)
    )
    return (
        documents.join(gone, same, "left")
        .withColumn(result, rebuilt(documents["text"], own_gone))
        .select(*others, f"{result}.*")
    )


def owned(store: LineRuns, lines: str, run: str) -> DataFrame:
    """The rows of a bucketed table that another document owns: read beside the run, bucket by bucket."""
    first = store.table(run).withColumnRenamed("owner", "first")
    rows = store.table(lines).filter("mark IS NOT NULL").join(first.hint("merge"), "key")
    return rows.filter("owner <> first").select("owner", "mark", "key")


def common(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """The same of the common lines."""
    first = F.broadcast(hot.withColumnRenamed("owner", "first"))
    return lines.join(first, "key").filter("owner <> first").select("owner", "mark", "key")


def shortened(documents: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    """``documents`` with the kept text in place of the text, and ``n_chars`` of it.

    A document that loses all its lines stays, with an empty text.
    """
    kept = deduplicate(documents, scratch, **parameters)
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    columns = [changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns]
    return kept.select(*columns)
