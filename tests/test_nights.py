"""Nights that read what they touch: the index from id to day, and the folders of days."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from test_batch import deliver_on, submission
from test_tables import silver

from learnlens import schemas
from learnlens.plans import batch
from learnlens.sources import tables
from learnlens.sources.tables import Warehouse

NAME, DAY, START = "silver_submissions", 86400, 1704067200.0
ONE, TWO, THREE = (date(2024, 1, d) for d in (1, 2, 3))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "submission_id string")


def days(frame):
    return sorted(str(r.day) for r in frame.collect())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, root):
    warehouse = Warehouse(spark, root)
    warehouse.write_snapshot(silver(spark, ("a", 1, ONE), ("b", 2, TWO), ("c", 3, THREE), ("n", 4, None)), NAME)
    return warehouse


def test_the_index_names_the_days_of_ids(spark, stored):
    index = stored.index(NAME)
    assert days(index.days_of(ids(spark, "a", "c", "unknown"))) == ["2024-01-01", "2024-01-03"]
    assert days(index.days_of(ids(spark, "n"))) == ["None"]
    assert days(index.days_of(ids(spark).limit(0))) == []
    stored.overwrite_days(silver(spark, ("a", 1, TWO), ("b", 2, TWO)), NAME)
    assert days(index.days_of(ids(spark, "a"))) == ["2024-01-01", "2024-01-02"]  # it may name too many
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("index_")]


def test_the_index_is_read_without_a_shuffle(spark, stored):
    stored.overwrite_days(silver(spark, ("a", 1, TWO)), NAME)
    many = spark.range(100).select(F.concat(F.lit("s"), "id").alias("submission_id"))
    plan = plan_of(stored.index(NAME).days_of(many))
    # the ids that came are dealt out for each run, the days found are made distinct; no run moves
    assert plan.count("ShuffledHashJoin") == 2 and "SelectedBucketsCount" in plan
    assert plan.count("Exchange hashpartitioning(submission_id") <= 2
    assert "Sort " not in plan


def test_runs_of_the_index_are_merged(spark, stored):
    index = stored.index(NAME)
    index.most_runs = 3
    for number in range(10, 17):
        index.add(silver(spark, (f"x{number}", 1, TWO), ("a", 1, THREE)), number)
        assert len(index.runs()) <= 3
    assert days(index.days_of(ids(spark, "x10", "a"))) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    kept = {run for number in index.lists()[-2:] for run, _ in index.runs(number)}
    assert set(stored.numbered(index.folder, "run=")) == kept and len(index.lists()) == 2


def test_only_the_folders_of_touched_days_are_read(spark, stored):
    touched = spark.createDataFrame([(TWO,), (None,), (date(1999, 1, 1),)], "day date")
    found = stored.read_touched(NAME, touched)
    assert sorted(r.submission_id for r in found.collect()) == ["b", "n"]
    assert {f.split("/")[-2] for f in found.inputFiles()} == {"day=2024-01-02", "day=__HIVE_DEFAULT_PARTITION__"}
    assert stored.read_touched(NAME, touched.limit(0)).isEmpty()


def test_very_many_days_are_joined(spark, stored, monkeypatch):
    monkeypatch.setattr(tables, "MOST_FOLDERS", 1)
    touched = spark.createDataFrame([(ONE,), (THREE,)], "day date")
    assert sorted(r.submission_id for r in stored.read_touched(NAME, touched).collect()) == ["a", "c"]


def test_a_night_reads_no_other_day(spark, root, monkeypatch):
    warehouse = Warehouse(spark, root)
    first = [submission(i, epoch=START + i * DAY) for i in range(6)]
    deliver_on(warehouse, "bronze_submissions", schemas.SUBMISSION, "2024-02-01", *first)
    batch.refresh(warehouse, ["2024-02-01"])
    moved = submission(2, epoch=START + 4 * DAY), submission(9, epoch=START)
    deliver_on(warehouse, "bronze_submissions", schemas.SUBMISSION, "2024-02-02", *moved)
    read, seen = Warehouse.read_touched, []

    def watched(self, name, days):
        found = read(self, name, days)
        seen.extend(f.split("/")[-2] for f in found.inputFiles())
        return found

    monkeypatch.setattr(Warehouse, "read_touched", watched)
    monkeypatch.setattr(Warehouse, "_read_days", lambda *_: pytest.fail("the table was read whole"))
    batch.refresh(warehouse, ["2024-02-02"])
    assert set(seen) == {"day=2024-01-01", "day=2024-01-03", "day=2024-01-05"}
    monkeypatch.undo()
    got = sorted((r.submission_id, str(r.day)) for r in warehouse.read(NAME).collect())
    assert got == [
        ("s0", "2024-01-01"), ("s1", "2024-01-02"), ("s2", "2024-01-05"), ("s3", "2024-01-04"),
        ("s4", "2024-01-05"), ("s5", "2024-01-06"), ("s9", "2024-01-01"),
    ]


def test_a_table_from_before_the_index(spark, root, monkeypatch):
    warehouse = Warehouse(spark, root)
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "index", lambda *_: None)
        warehouse.write_snapshot(silver(spark, ("a", 1, ONE)), NAME)
    assert days(warehouse.days_holding(NAME, ids(spark, "a"))) == ["2024-01-01"]
    warehouse.overwrite_days(silver(spark, ("b", 1, TWO)), NAME)  # an index of these rows alone would miss a
    assert days(warehouse.days_holding(NAME, ids(spark, "a", "b"))) == ["2024-01-01", "2024-01-02"]
    warehouse.write_snapshot(silver(spark, ("a", 1, THREE)), NAME)
    assert days(warehouse.days_holding(NAME, ids(spark, "a", "b"))) == ["2024-01-03"]
