"""Stored tables: plain Parquet folders on the shared file system.

A snapshot is written beside the one being read and counts once Spark has put its success
marker there, so readers always see one whole snapshot and never an empty table.

Tables by day are replaced day by day.  Each write is a version folder with the days it holds; a
list of days (``days=<number>``) says which version of each day counts, and is written last.  A
folder is never changed once it is complete, and a day that got no rows is on no list.  Daily
totals follow the list of the table they are sums of: both change at one moment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from learnlens import schemas
from learnlens.operators.dedup import latest_by_key
from learnlens.sources.index import DayIndex
from learnlens.sources.logs import BatchLog

_VERSION, _GENERATION, _CLEARED, _LOAD = "version=", "generation=", "cleared=", "load="
_BASE, _BATCH, _DAYS = "as_of=", "batch_id=", "days="
_LISTED = StructType([StructField("day", DateType()), StructField("version", LongType())])
_NULL_DAY = "__HIVE_DEFAULT_PARTITION__"
MOST_FOLDERS = 10_000  # that are named one by one


def _sorted(df: DataFrame, name: str) -> DataFrame:
    columns = (*schemas.PARTITION_COLUMNS.get(name, ()), *schemas.SORT_COLUMNS.get(name, ()))
    return df.sortWithinPartitions(
        *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in columns]
    )


class Warehouse:
    """The tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # folders --------------------------------------------------------------------------

    def numbered(
        self, folder: str, prefix: str, complete: bool = False, after: int | None = None
    ) -> list[int]:
        """Numbers of the ``prefix<number>`` folders below ``folder``, ascending."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if not name.startswith(prefix):
                continue
            if after is not None and int(name[len(prefix) :]) <= after:
                continue
            if complete and not fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                continue
            found.append(int(name[len(prefix) :]))
        return sorted(found)

    def remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _empty(self, schema: StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    # snapshots ------------------------------------------------------------------------

    def versions(self, name: str) -> list[int]:
        return self.numbered(self._table(name), _VERSION, complete=True)

    def read(self, name: str, columns: Sequence[str] = ()) -> DataFrame:
        """The newest whole snapshot; empty when there is none yet."""
        schema = schemas.TABLES[name]
        if name in schemas.BY_DAY:
            df = self._read_days(name)
        elif done := self.versions(name):
            df = self.spark.read.schema(schema).parquet(f"{self._table(name)}/{_VERSION}{done[-1]}")
        else:
            df = self._empty(schema)
        return df.select(*columns) if columns else df

    def write_snapshot(self, df: DataFrame, name: str) -> None:
        """Replace the table by ``df`` in the stored column order."""
        if name in schemas.BY_DAY:
            self.write_days({name: lambda _: df})
        else:
            self._write_version(df, name, self._next(name))

    def _next(self, *names: str) -> int:
        """A number that no folder of these tables has."""
        used = [
            number
            for name in names
            for prefix in (_VERSION, _DAYS)
            for number in self.numbered(self._table(name), prefix)
        ]
        return max(used, default=-1) + 1

    def _write_version(self, df: DataFrame, name: str, number: int) -> str:
        target = f"{self._table(name)}/{_VERSION}{number}"
        partition_by = schemas.PARTITION_COLUMNS.get(name, ())
        self._laid_out(df, name).write.partitionBy(*partition_by).parquet(target)
        return target

    def upsert(self, df: DataFrame, name: str, order: Sequence[str] = ()) -> None:
        """Merge ``df`` into the table by its key; new rows win over stored ones."""
        columns = schemas.TABLES[name].names
        stored = self.read(name).withColumn("_write", F.lit(0))
        merged = stored.unionByName(df.select(*columns).withColumn("_write", F.lit(1)))
        latest = latest_by_key(merged, schemas.TABLE_KEYS[name], ("_write", *order))
        self.write_snapshot(latest.select(*columns), name)

    # tables by day --------------------------------------------------------------------

    def _lists(self, name: str) -> list[int]:
        """Numbers of the lists of days that count, the newest last."""
        own = self.numbered(self._table(name), _DAYS, complete=True)
        leader = schemas.BY_DAY[name]
        if leader == name:
            return own
        newest = self._lists(leader)
        return [n for n in own if newest and n <= newest[-1]]

    def _listed(self, name: str, number: int) -> DataFrame:
        return self.spark.read.schema(_LISTED).parquet(f"{self._table(name)}/{_DAYS}{number}")

    def _read_days(self, name: str) -> DataFrame:
        schema, folder, lists = schemas.TABLES[name], self._table(name), self._lists(name)
        if not lists:
            return self._empty(schema)
        versions = [n for n in self.numbered(folder, _VERSION, complete=True) if n <= lists[-1]]
        rows = (
            self.spark.read.schema(StructType([*schema.fields]).add("version", LongType()))
            .option("basePath", folder)
            .parquet(*[f"{folder}/{_VERSION}{n}" for n in versions])
        )
        live = self._listed(name, lists[-1]).toDF("_day", "_version")
        own = rows["day"].eqNullSafe(live["_day"]) & (rows["version"] == live["_version"])
        return rows.join(live, own, "left_semi").select(*schema.names)

    def index(self, name: str) -> DayIndex | None:
        """Where the ids of a table by day are stored."""
        if name not in schemas.INDEXED:
            return None
        return DayIndex(self, f"{self._table(name)}/ids", schemas.INDEXED[name])

    def read_touched(self, name: str, days: DataFrame) -> DataFrame:
        """The rows of ``days``: only their folders are listed and read.

        A table whose ``days`` are in more than ``MOST_FOLDERS`` folders is read whole and joined.
        """
        schema, folder, lists = schemas.TABLES[name], self._table(name), self._lists(name)
        if not lists:
            return self._empty(schema)
        listed = self._listed(name, lists[-1])
        wanted = listed.join(days, listed["day"].eqNullSafe(days["day"]), "left_semi")
        found = wanted.select(F.col("day").cast("string").alias("day"), "version").limit(MOST_FOLDERS + 1).collect()
        if len(found) > MOST_FOLDERS:
            rows = self._read_days(name)
            return rows.join(days, rows["day"].eqNullSafe(days["day"]), "left_semi")
        if not found:
            return self._empty(schema)
        paths = [f"{folder}/{_VERSION}{row.version}/day={row.day or _NULL_DAY}" for row in found]
        reader = self.spark.read.schema(StructType([*schema.fields]).add("version", LongType()))
        return reader.option("basePath", folder).parquet(*sorted(paths)).select(*schema.names)

    def days_holding(self, name: str, ids: DataFrame) -> DataFrame:
        """Days under which any of ``ids`` is stored, from the index, or from the table if it has none."""
        index = self.index(name)
        if index and index.lists():
            return index.days_of(ids)
        if not self._lists(name):
            return self._empty(_LISTED).select("day")
        keys = list(schemas.TABLE_KEYS[name])
        return self.read(name).select(*keys, "day").join(ids, keys, "left_semi").select("day").distinct()

    def write_days(
        self, steps: Mapping[str, Callable[[DataFrame | None], DataFrame]], days: DataFrame | None = None
    ) -> None:
        """Replace ``days`` (all without it) of tables that change at one moment, the leader first.

        A step gets the rows that the step before it stored.  Days without rows are gone.
        """
        names = list(steps)
        number, stored = self._next(*names), None
        for name, step in steps.items():
            target = self._write_version(step(stored), name, number)
            stored = self.spark.read.schema(schemas.TABLES[name]).parquet(target)
            index = self.index(name)
            if index and (days is None or index.lists() or not self._lists(name)):
                index.add(stored, number, anew=days is None)  # before the rows count: it may name too many
        for name in reversed(names):  # the leader's list makes all of them count
            folder, before = self._table(name), self._lists(name)
            held = self.spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{_VERSION}{number}")
            listed = held.select("day").distinct().withColumn("version", F.lit(number).cast("long"))
            if days is not None and before:
                old = self._listed(name, before[-1])
                others = old.join(days, old["day"].eqNullSafe(days["day"]), "left_anti")
                listed = others.unionByName(listed)
            listed.coalesce(1).write.parquet(f"{folder}/{_DAYS}{number}")

    def overwrite_days(self, df: DataFrame, name: str) -> None:
        """Replace the days that ``df`` holds; the others stay."""
        self.write_days({name: lambda _: df}, df.select("day").distinct())

    def expire(self, name: str, keep: int = 2) -> None:
        """Drop all but the ``keep`` newest whole snapshots, and half-written ones before them."""
        if name in schemas.BY_DAY:
            self._expire_days(name, keep)
            return
        kept = self.versions(name)[-max(keep, 1) :]
        for version in self.numbered(self._table(name), _VERSION):
            if kept and version < kept[-1] and version not in kept:
                self.remove(f"{self._table(name)}/{_VERSION}{version}")

    def _expire_days(self, name: str, keep: int) -> None:
        """Drop old lists, and the days of each version that no kept list names."""
        folder, kept = self._table(name), self._lists(name)[-max(keep, 1) :]
        if not kept:
            return
        for number in self.numbered(folder, _DAYS):
            if number < kept[-1] and number not in kept:
                self.remove(f"{folder}/{_DAYS}{number}")
        live = reduce(DataFrame.unionByName, [self._listed(name, n) for n in kept]).distinct()
        named = {row.version for row in live.select("version").distinct().collect()}  # one per night
        for version in self.numbered(folder, _VERSION):
            if version < kept[-1] and version not in named:
                self.remove(f"{folder}/{_VERSION}{version}")
            elif version <= kept[-1]:
                held = self.partitions(f"{folder}/{_VERSION}{version}", "day")
                used = live.filter(F.col("version") == version).select(F.col("day").cast("string"))
                current = {row.day or _NULL_DAY for row in used.toLocalIterator()}
                for day in held - current:
                    self.remove(f"{folder}/{_VERSION}{version}/day={day}")

    def partitions(self, folder: str, column: str) -> set[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return {n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")}

    def _laid_out(self, df: DataFrame, name: str) -> DataFrame:
        """Column order, and file layout for partitioned tables.

        Rebalancing gives each partition value as many tasks as its size asks for: a small day
        makes one file, a day with a third of the rows many.
        """
        df = df.select(*schemas.TABLES[name].names)
        partition_by = schemas.PARTITION_COLUMNS.get(name)
        if not partition_by:
            return df
        return _sorted(df.hint("rebalance", *partition_by), name)

    # stream tables --------------------------------------------------------------------

    def generation(self) -> int:
        """Number of the current run of the streams; a fresh start opens the next one."""
        found = self.numbered(f"{self.root}/_generations", _GENERATION)
        return found[-1] if found else 0

    def open_generation(self, keep_tables: bool = False) -> int:
        """Begin with new checkpoints, and with empty stream tables unless they are kept."""
        number = self.generation() + 1
        if not keep_tables:
            self._mark(f"{self.root}/_generations/{_CLEARED}{number}")
        self._mark(f"{self.root}/_generations/{_GENERATION}{number}")
        return number

    def _mark(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)

    def _live_generations(self, name: str) -> list[int]:
        """Generations of a stream table since it was last cleared."""
        cleared = self.numbered(f"{self.root}/_generations", _CLEARED)
        first = cleared[-1] if cleared else 0
        return [n for n in self.numbered(self._table(name), _GENERATION) if n >= first]

    def stream_path(self, name: str, generation: int | None = None) -> str:
        number = self.generation() if generation is None else generation
        return f"{self._table(name)}/{_GENERATION}{number}"

    def log(self, name: str, generation: int | None = None) -> BatchLog:
        """The micro-batches of raw messages or alerts in one generation."""
        schema = schemas.LOGS[name]
        partition_by, sort_by = schemas.PARTITION_COLUMNS[name], schemas.SORT_COLUMNS[name]
        return BatchLog(self, self.stream_path(name, generation), schema, partition_by, sort_by)

    def read_bronze(self, name: str, accepted: bool = True, days: Sequence[str] | None = None) -> DataFrame:
        """Raw messages of all stream generations and loads; with ``days`` those that came then.

        Only the folders of ``days`` are listed and read.
        """
        schema, folder = schemas.LOGS[name], self._table(name)
        parts = [self.log(name, number).read(days) for number in self.numbered(folder, _GENERATION)]
        for number in self.numbered(folder, _LOAD, complete=True):
            load = f"{folder}/{_LOAD}{number}"
            paths = [load]
            if days is not None:
                paths = [f"{load}/ingest_day={d}" for d in sorted(self.partitions(load, "ingest_day") & set(days))]
            if paths:
                rows = self.spark.read.schema(schema).option("basePath", load).parquet(*paths)
                parts.append(rows.select(*schema.names))
        parts = [part for part in parts if part is not None]
        if not parts:
            return self._empty(schema)
        return reduce(DataFrame.unionByName, parts).filter(F.col("accepted") == accepted)

    def append_bronze(self, df: DataFrame, name: str) -> None:
        """Batch load of raw messages, kept apart from the folders the streams commit to."""
        started = self.numbered(self._table(name), _LOAD)
        number = started[-1] + 1 if started else 0
        df.write.partitionBy("ingest_day", "accepted").parquet(f"{self._table(name)}/{_LOAD}{number}")

    def read_alerts(self) -> DataFrame:
        """Alerts since the table was last cleared."""
        name = "gold_system_alerts"
        schema = schemas.TABLES[name]
        parts = [self.log(name, number).read() for number in self._live_generations(name)]
        parts = [part.select(*schema.names) for part in parts if part is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self._empty(schema)

    # The leaderboard stream emits the users that changed.  Rewriting all users per micro-batch
    # would cost as much as the table, so changes are stored per batch and folded now and then.

    def write_changes(self, df: DataFrame, name: str, batch_id: int) -> None:
        """Store the changed rows of one micro-batch; a replay replaces them."""
        path = f"{self.stream_path(name)}/changes/{_BATCH}{batch_id}"
        df.select(*schemas.TABLES[name].names).write.mode("overwrite").parquet(path)

    def read_current(self, name: str) -> DataFrame:
        """Newest row per key: per generation the last fold and the changes since."""
        columns = schemas.TABLES[name].names
        parts = [
            self._changes(name, number).withColumn("generation", F.lit(number))
            for number in self._live_generations(name)
        ]
        if not parts:
            return self._empty(schemas.TABLES[name])
        rows = reduce(DataFrame.unionByName, parts)
        order = ("generation", "batch_id")
        return latest_by_key(rows, schemas.TABLE_KEYS[name], order).select(*columns)

    def fold_changes(self, name: str, batch_id: int) -> None:
        """Write the state as of ``batch_id``, so that readers skip the changes before it.

        The fold before and the changes since then stay, for readers that have just begun.
        """
        rows = self._changes(name, self.generation()).filter(F.col("batch_id") <= batch_id)
        latest = latest_by_key(rows, schemas.TABLE_KEYS[name], ("batch_id",))
        target = f"{self.stream_path(name)}/base/{_BASE}{batch_id}"
        _sorted(latest, name).write.mode("overwrite").parquet(target)

        folder = self.stream_path(name)
        folds = self.numbered(f"{folder}/base", _BASE, complete=True)
        if len(folds) > 1:
            for old in folds[:-2]:
                self.remove(f"{folder}/base/{_BASE}{old}")
            for old in self.numbered(f"{folder}/changes", _BATCH):
                if old <= folds[-2]:
                    self.remove(f"{folder}/changes/{_BATCH}{old}")

    def _changes(self, name: str, generation: int) -> DataFrame:
        folder = self.stream_path(name, generation)
        stored = StructType([*schemas.TABLES[name].fields]).add("batch_id", LongType())
        folds = self.numbered(f"{folder}/base", _BASE, complete=True)
        since = folds[-1] if folds else -1
        # batches are listed one by one only since the last fold, so the list stays short
        recent = [
            f"{folder}/changes/{_BATCH}{number}"
            for number in self.numbered(f"{folder}/changes", _BATCH, complete=True, after=since)
        ]
        reader = self.spark.read.schema(stored)
        parts = [reader.parquet(f"{folder}/base/{_BASE}{since}")] if folds else []
        if recent:
            parts.append(reader.option("basePath", f"{folder}/changes").parquet(*recent))
        return reduce(DataFrame.unionByName, parts) if parts else self._empty(stored)

    # checks ---------------------------------------------------------------------------

    def row_counts(self, names: Iterable[str]) -> DataFrame:
        """Rows per table, for the operator who wants to see that tables are filled."""
        counts = [
            self._any(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            for name in names
        ]
        return reduce(DataFrame.unionByName, counts)

    def _any(self, name: str) -> DataFrame:
        if name == "gold_live_leaderboard":
            return self.read_current(name)
        if name == "gold_system_alerts":
            return self.read_alerts()
        if name in schemas.BRONZE_KEYS:
            return self.read_bronze(name)
        return self.read(name)
