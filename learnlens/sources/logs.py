"""Tables that streams append to: folders of micro-batches, a manifest, compaction.

A micro-batch is written to its own folder under its number, so a replay replaces it.  Now and
then what came since is folded: rows go to a run, a folder by day with few large files, and a manifest
says which runs of which days count, and through which batch.  The manifest is written last, and its
success marker switches readers at one moment.  When a day is over, its runs become one; so do those of
the open day once there are ``most_runs`` of them.

    batches/batch_id=<n>/             a micro-batch
    runs/run=<n>/<day>=<day>/...      what was folded with batch n
    manifests/manifest=<n>/           (day, run), through batch n

Readers list the folders that the newest manifest names and the batches since, never the whole table, and
with ``days`` only the folders of these.  What the manifest before names stays for readers that have just begun.
Days are those of the clock that writes, so there are few, and their list is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

if TYPE_CHECKING:
    from learnlens.sources.tables import Warehouse

_BATCH, _RUN, _MANIFEST = "batch_id=", "run=", "manifest="
_LISTED = StructType([StructField("day", DateType()), StructField("run", LongType())])
Listed = set[tuple[str, int]]


class BatchLog:
    """One generation of a stream table.  ``partition_by`` starts with the column of the day."""

    def __init__(
        self,
        warehouse: Warehouse,
        folder: str,
        schema: StructType,
        partition_by: Sequence[str],
        sort_by: Sequence[str] = (),
        most_runs: int = 8,
    ):
        self.warehouse, self.spark, self.folder, self.schema = warehouse, warehouse.spark, folder, schema
        self.partition_by, self.sort_by, self.most_runs = list(partition_by), list(sort_by), most_runs
        self.day = partition_by[0]

    # folders --------------------------------------------------------------------------

    def manifests(self) -> list[int]:
        return self.warehouse.numbered(f"{self.folder}/manifests", _MANIFEST, complete=True)

    def batches(self, after: int = -1) -> list[int]:
        return self.warehouse.numbered(f"{self.folder}/batches", _BATCH, complete=True, after=after)

    def through(self) -> int:
        """The last batch that is folded."""
        return (self.manifests() or [-1])[-1]

    def listed(self, manifest: int) -> Listed:
        """The days and runs of a manifest: a row per closed day, a few for the open one."""
        if manifest < 0:
            return set()
        rows = self.spark.read.schema(_LISTED).parquet(f"{self.folder}/manifests/{_MANIFEST}{manifest}")
        return {(str(row.day), row.run) for row in rows.collect()}

    def _run_path(self, day: str, run: int) -> str:
        return f"{self.folder}/runs/{_RUN}{run}/{self.day}={day}"

    # rows -----------------------------------------------------------------------------

    def _runs(self, listed: Iterable[tuple[str, int]]) -> DataFrame | None:
        paths = [self._run_path(*one) for one in sorted(listed)]
        if not paths:
            return None
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/runs")
        return reader.parquet(*paths).select(*self.schema.names)

    def _fresh(self, numbers: Sequence[int]) -> DataFrame | None:
        if not numbers:
            return None
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/batches")
        return reader.parquet(*[f"{self.folder}/batches/{_BATCH}{n}" for n in numbers]).select(*self.schema.names)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store a micro-batch; a replay replaces it, and one that is folded already is left."""
        if batch_id > self.through():
            # the batch's size decides how many files it makes, not the number of tasks
            written = rows.select(*self.schema.names).hint("rebalance").write
            written.mode("overwrite").parquet(f"{self.folder}/batches/{_BATCH}{batch_id}")

    def read(self, days: Sequence[str] | None = None) -> DataFrame | None:
        """All rows, or those of ``days``; None if there never were any."""
        last = self.through()
        listed, fresh = self.listed(last), self._fresh(self.batches(last))
        if days is not None:
            listed = {one for one in listed if one[0] in days}
            fresh = fresh and fresh.filter(F.col(self.day).cast("string").isin(list(days)))
        parts = [part for part in (self._runs(listed), fresh) if part is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    # compaction -----------------------------------------------------------------------

    def compact(self, through: int) -> None:
        """Fold the batches up to ``through`` that are not folded yet; once more does nothing."""
        last = self.through()
        numbers = [n for n in self.batches(last) if n <= through]
        fresh = self._fresh(numbers)
        if fresh is None:
            return
        before = self.listed(last)
        came = {str(row[0]) for row in fresh.select(self.day).distinct().collect()}
        runs: dict[str, list[int]] = {}
        for day, run in before:
            runs.setdefault(day, []).append(run)
        open_day = max([*came, *runs], default="")
        merged = {
            day for day, own in runs.items()
            if len(own) + (day in came) > (1 if day < open_day else self.most_runs)
        }
        old = self._runs({one for one in before if one[0] in merged})
        rows = fresh if old is None else fresh.unionByName(old)
        target = f"{self.folder}/runs/{_RUN}{through}"
        laid_out = rows.hint("rebalance", *self.partition_by).sortWithinPartitions(*self.partition_by, *self.sort_by)
        laid_out.write.mode("overwrite").partitionBy(*self.partition_by).parquet(target)

        now = {one for one in before if one[0] not in merged} | {(day, through) for day in came | merged}
        listed = self.spark.createDataFrame(sorted(now), "day string, run long").withColumn("day", F.col("day").cast("date"))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{_MANIFEST}{through}")
        self._clean(last, through, before | now)

    def _clean(self, last: int, through: int, kept: Listed) -> None:
        """Remove what neither this manifest nor the one before names."""
        numbered, remove = self.warehouse.numbered, self.warehouse.remove
        for number in numbered(f"{self.folder}/manifests", _MANIFEST):
            if number < last:
                remove(f"{self.folder}/manifests/{_MANIFEST}{number}")
        for number in numbered(f"{self.folder}/batches", _BATCH):
            if number <= last:
                remove(f"{self.folder}/batches/{_BATCH}{number}")
        for run in numbered(f"{self.folder}/runs", _RUN):
            if run < through:
                there = self.warehouse.partitions(f"{self.folder}/runs/{_RUN}{run}", self.day)
                gone = {day for day in there if (day, run) not in kept}
                if gone == there:
                    remove(f"{self.folder}/runs/{_RUN}{run}")
                else:
                    for day in gone:
                        remove(self._run_path(day, run))
