"""Where ids are stored: an index from id to day, for tables by day.

Every write of days adds a run: the ids it stored and their days, in a folder of files bucketed by id and
sorted inside.  A look-up joins the ids that came with each run bucket by bucket: the ids that came are dealt
to the buckets and hashed, the run is read where it lies, two columns of it, without a shuffle.  An
entry stays when its row is gone, so the days found are those that hold an id and some that held it once; that
is all a night needs, which then reads and writes the folders of these days alone.

When there are ``most_runs`` runs they are merged into one.  A list of runs (``list=<n>``), written last, says
which count; a list and its runs stay until the list after the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

if TYPE_CHECKING:
    from learnlens.sources.tables import Warehouse

_RUN, _LIST = "run=", "list="
_LISTED = StructType([StructField("run", LongType()), StructField("buckets", IntegerType())])


class DayIndex:
    """``key`` is a text column.  The buckets of a run are as many as the session's shuffles have partitions."""

    def __init__(self, warehouse: Warehouse, folder: str, key: str, most_runs: int = 8):
        self.warehouse, self.spark, self.folder, self.key = warehouse, warehouse.spark, folder, key
        self.most_runs = most_runs

    def lists(self) -> list[int]:
        return self.warehouse.numbered(self.folder, _LIST, complete=True)

    def runs(self, number: int | None = None) -> list[tuple[int, int]]:
        """``(run, buckets)`` of a list, the newest without a number."""
        if number is None:
            lists = self.lists()
            if not lists:
                return []
            number = lists[-1]
        rows = self.spark.read.schema(_LISTED).parquet(f"{self.folder}/{_LIST}{number}").collect()
        return sorted((row.run, row.buckets) for row in rows)

    def add(self, rows: DataFrame, number: int, anew: bool = False) -> None:
        """Add the ids and days of ``rows``; ``anew`` forgets all runs before."""
        before = [] if anew else [one for one in self.runs() if one[0] != number]
        rows = rows.select(self.key, "day")
        if len(before) + 1 >= self.most_runs:
            with self._tables(before) as tables:
                self._write(reduce(DataFrame.unionByName, [rows, *tables]).distinct(), number)
            before = []
        else:
            self._write(rows, number)
        listed = [*before, (number, self._buckets())]
        self.spark.createDataFrame(listed, _LISTED).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/{_LIST}{number}"
        )
        self._clean()

    def days_of(self, ids: DataFrame) -> DataFrame:
        """The distinct days under which any of ``ids`` is or was stored; stage it before ids change."""
        with self._tables(self.runs()) as tables:
            found = [
                table.join(ids.select(self.key).hint("shuffle_hash"), self.key, "left_semi").select("day")
                for table in tables
            ]
        return reduce(DataFrame.unionByName, found).distinct()

    # storage --------------------------------------------------------------------------

    def _buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, number: int) -> None:
        name, buckets = f"index_{uuid.uuid4().hex}", self._buckets()
        dealt = rows.repartition(buckets, self.key)  # dealt as buckets are: a file each
        writer = dealt.write.mode("overwrite").bucketBy(buckets, self.key).sortBy(self.key)
        writer.option("path", f"{self.folder}/{_RUN}{number}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    @contextmanager
    def _tables(self, runs: list[tuple[int, int]]) -> Iterator[list[DataFrame]]:
        """The runs as bucketed tables, which are in the catalog only while they are looked up there."""
        names, tables = [], []
        try:
            for run, buckets in runs:
                names.append(f"index_{uuid.uuid4().hex}")
                self.spark.sql(
                    f"CREATE TABLE {names[-1]} (`{self.key}` STRING, day DATE) USING parquet "
                    f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS "
                    f"LOCATION '{self.folder}/{_RUN}{run}'"
                )
                tables.append(self.spark.table(names[-1]))
            yield tables
        finally:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _clean(self) -> None:
        lists = self.lists()
        kept = {run for number in lists[-2:] for run, _ in self.runs(number)}
        for number in self.warehouse.numbered(self.folder, _LIST):
            if number < lists[-1] and number not in lists[-2:]:
                self.warehouse.remove(f"{self.folder}/{_LIST}{number}")
        for run in self.warehouse.numbered(self.folder, _RUN):
            if run < lists[-1] and run not in kept:
                self.warehouse.remove(f"{self.folder}/{_RUN}{run}")


def distinct_days(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [frame.select(F.col("day")) for frame in frames]).distinct()
