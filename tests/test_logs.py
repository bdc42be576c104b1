"""Stream tables: replay, crash, compaction, listing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from learnlens import schemas
from learnlens.sources.logs import BatchLog
from learnlens.sources.tables import Warehouse

NAME = "bronze_submissions"


def rows(spark, day, *numbers, accepted=True):
    at = datetime.fromisoformat(f"{day} 12:00:00")
    data = [(f"s{n}" if accepted else None, at, "{}", None, at.date(), accepted) for n in numbers]
    return spark.createDataFrame(data, schemas.LOGS[NAME])


@pytest.fixture()
def warehouse(spark, root):
    return Warehouse(spark, root)


@pytest.fixture()
def log(warehouse):
    return warehouse.log(NAME)


def ids(log, days=None):
    found = log.read(days)
    return sorted(int(r.submission_id[1:]) for r in found.collect()) if found is not None else []


def folders(log, kind):
    return log.warehouse.numbered(f"{log.folder}/{kind}", {"batches": "batch_id=", "runs": "run=", "manifests": "manifest="}[kind])


def test_a_replayed_batch_counts_once(spark, log):
    log.write(rows(spark, "2024-01-01", 1, 2), 0)
    log.write(rows(spark, "2024-01-01", 1, 2), 0)
    assert ids(log) == [1, 2]
    log.compact(0)
    log.write(rows(spark, "2024-01-01", 1, 2), 0)  # the checkpoint was not written before the fold
    log.compact(0)
    assert ids(log) == [1, 2] and log.manifests() == [0]


def test_a_half_written_batch_is_not_read(spark, log, tmp_path):
    log.write(rows(spark, "2024-01-01", 1), 0)
    (tmp_path / "warehouse" / NAME / "generation=0" / "batches" / "batch_id=1" / "_temporary").mkdir(parents=True)
    assert ids(log) == [1]
    log.write(rows(spark, "2024-01-01", 2), 1)
    assert ids(log) == [1, 2]


@pytest.mark.parametrize("moment", ["runs", "manifests"])
def test_a_fold_that_was_cut_changes_nothing_and_is_done_again(spark, log, monkeypatch, moment):
    for i in range(3):
        log.write(rows(spark, f"2024-01-0{i + 1}", i), i)
    log.compact(1)
    log.write(rows(spark, "2024-01-03", 3), 3)
    from pyspark.sql import DataFrameWriter

    write = DataFrameWriter.parquet

    def cut(self, path, *args, **kwargs):
        if f"/{moment}/" in path:
            raise OSError("lost")
        write(self, path, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", cut)
        with pytest.raises(OSError, match="lost"):
            log.compact(3)
    assert ids(log) == [0, 1, 2, 3] and log.manifests() == [1]
    log.compact(3)
    assert ids(log) == [0, 1, 2, 3] and log.through() == 3


def test_closed_days_become_one_run_and_old_folders_go(spark, log):
    number = 0
    for day in range(1, 5):
        for _ in range(6):
            log.write(rows(spark, f"2024-01-0{day}", number), number)
            if number % 2:
                log.compact(number)
            number += 1
    assert ids(log) == list(range(24))
    listed = log.listed(log.through())
    runs = {day: sorted(run for d, run in listed if d == day) for day, _ in listed}
    assert [len(runs[f"2024-01-0{d}"]) for d in (1, 2, 3)] == [1, 1, 1]
    assert len(runs["2024-01-04"]) == 3  # the open day
    # the last fold and the one before are there, no batch before them
    assert folders(log, "manifests") == [21, 23] and folders(log, "batches") == [22, 23]
    assert set(folders(log, "runs")) == {run for _, run in listed | log.listed(21)}


def test_runs_of_a_long_day_are_merged(spark, warehouse):
    log = BatchLog(warehouse, warehouse.stream_path(NAME), schemas.LOGS[NAME], ("ingest_day", "accepted"), most_runs=3)
    for number in range(9):
        log.write(rows(spark, "2024-01-01", number), number)
        log.compact(number)
        assert len(log.listed(number)) <= 3
    assert ids(log) == list(range(9))


def test_a_reader_that_has_begun_is_not_disturbed(spark, log):
    for i in range(4):
        log.write(rows(spark, "2024-01-01", i), i)
    log.compact(1)
    begun = log.read()
    log.compact(3)
    assert begun.count() == 4 and ids(log) == [0, 1, 2, 3]


def test_a_day_is_read_from_its_folders_alone(spark, warehouse, log):
    for i in range(4):
        log.write(rows(spark, f"2024-01-0{i + 1}", i).unionByName(rows(spark, f"2024-01-0{i + 1}", i, accepted=False)), i)
    log.compact(3)
    found = warehouse.read_bronze(NAME, days=["2024-01-02"])
    files = found.inputFiles()
    assert [r.submission_id for r in found.collect()] == ["s1"]
    assert files and all("ingest_day=2024-01-02" in f for f in files)
    assert warehouse.read_bronze(NAME, accepted=False).count() == 4
    assert warehouse.read_bronze(NAME, days=["1999-01-01"]).isEmpty()


def test_a_fold_writes_few_files(spark, log):
    many = spark.range(2000).select(
        F.format_string("s%d", "id").alias("submission_id"), F.lit(datetime(2024, 1, 1)).alias("ingest_timestamp"),
        F.lit("{}").alias("raw_payload"), F.lit(None).cast("string").alias("reason"),
        F.lit("2024-01-01").cast("date").alias("ingest_day"), F.lit(True).alias("accepted"),
    )
    for i in range(5):
        log.write(many.filter(F.col("submission_id") != f"s{i}").repartition(50), i)
    assert len(log.read().inputFiles()) <= 10
    log.compact(4)
    assert len(log.read().inputFiles()) == 1 and log.read().count() == 5 * 1999
