from datetime import date, datetime

from learnlens import schemas
from learnlens.sources.dimensions import read_dimension
from learnlens.sources.tables import Warehouse

NOW = datetime(2024, 1, 1)
SCORES = "gold_engagement_scores"


def scores(spark, *pairs):
    return spark.createDataFrame([(u, s, NOW) for u, s in pairs], schemas.TABLES[SCORES])


def stored(warehouse, name=SCORES, columns=("user_id", "engagement_score")):
    return sorted(tuple(r) for r in warehouse.read(name, columns).collect())


def test_a_table_that_was_never_written_is_empty(spark, root):
    warehouse = Warehouse(spark, root)
    for name in schemas.TABLES:
        assert warehouse.read(name).schema == schemas.TABLES[name]
        assert warehouse.read(name).isEmpty()
    assert warehouse.read_current("gold_live_leaderboard").isEmpty()
    assert warehouse.read_alerts().isEmpty()
    assert warehouse.read_bronze("bronze_submissions").isEmpty()


def test_a_snapshot_replaces_the_one_before(spark, root):
    warehouse = Warehouse(spark, root)
    warehouse.write_snapshot(scores(spark, ("a", 1), ("b", 2)), SCORES)
    before = warehouse.read(SCORES)
    warehouse.write_snapshot(scores(spark, ("c", 3)), SCORES)
    assert stored(warehouse) == [("c", 3)]
    assert before.count() == 2  # a reader that began earlier still sees its snapshot whole


def test_a_half_written_snapshot_is_not_read_and_not_reused(spark, root, tmp_path):
    warehouse = Warehouse(spark, root)
    warehouse.write_snapshot(scores(spark, ("a", 1)), SCORES)
    (tmp_path / "warehouse" / SCORES / "version=1" / "_temporary").mkdir(parents=True)
    assert stored(warehouse) == [("a", 1)]
    warehouse.write_snapshot(scores(spark, ("b", 2)), SCORES)
    assert warehouse.versions(SCORES) == [0, 2]
    assert stored(warehouse) == [("b", 2)]


def test_upsert_merges_by_key(spark, root):
    warehouse = Warehouse(spark, root)
    warehouse.upsert(scores(spark, ("a", 9), ("b", 2)), SCORES)
    warehouse.upsert(scores(spark, ("a", 1), ("c", 3)), SCORES)
    assert stored(warehouse) == [("a", 1), ("b", 2), ("c", 3)]
    warehouse.upsert(scores(spark, ("a", 1), ("c", 3)), SCORES)
    assert stored(warehouse) == [("a", 1), ("b", 2), ("c", 3)]


def test_expire_keeps_the_newest(spark, root):
    warehouse = Warehouse(spark, root)
    for i in range(4):
        warehouse.write_snapshot(scores(spark, ("a", i)), SCORES)
    warehouse.expire(SCORES, keep=2)
    assert warehouse.versions(SCORES) == [2, 3]
    warehouse.expire(SCORES, keep=0)
    assert stored(warehouse) == [("a", 3)]
    warehouse.expire("gold_difficulty_heatmap")  # never written


def test_expire_takes_half_written_snapshots_along(spark, root, tmp_path):
    warehouse = Warehouse(spark, root)
    broken = tmp_path / "warehouse" / SCORES
    (broken / "version=0").mkdir(parents=True)
    warehouse.write_snapshot(scores(spark, ("a", 1)), SCORES)
    (broken / "version=2").mkdir()  # perhaps still being written
    warehouse.expire(SCORES)
    assert sorted(p.name for p in broken.iterdir()) == ["version=1", "version=2"]
    assert stored(warehouse) == [("a", 1)]


def silver(spark, *data):
    return spark.createDataFrame(
        [("p", "u", NOW, i, "Pass", ms, 1, day) for i, ms, day in data], schemas.TABLES["silver_submissions"]
    )


def test_days_are_replaced_one_by_one(spark, root):
    warehouse = Warehouse(spark, root)
    one, two = date(2024, 1, 1), date(2024, 1, 2)
    warehouse.overwrite_days(silver(spark, ("a", 1, one), ("b", 2, two)), "silver_submissions")
    warehouse.overwrite_days(silver(spark, ("c", 3, two)), "silver_submissions")
    assert stored(warehouse, "silver_submissions", ("submission_id", "day")) == [("a", one), ("c", two)]


def test_a_day_filter_prunes_partitions(spark, root):
    warehouse = Warehouse(spark, root)
    warehouse.write_snapshot(silver(spark, ("a", 1, date(2024, 1, 1)), ("b", 2, date(2024, 1, 2))), "silver_submissions")
    df = warehouse.read("silver_submissions").filter("day = '2024-01-02' AND status = 'Pass'").select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(status,Pass)" in plan
    assert df.count() == 1


def board(spark, *pairs):
    return spark.createDataFrame(
        [("Global", u, n, "Pass", NOW) for u, n in pairs], schemas.TABLES["gold_live_leaderboard"]
    )


def current(warehouse):
    rows = warehouse.read_current("gold_live_leaderboard").collect()
    return sorted((r.user_id, r.total_solved) for r in rows)


def test_changes_fold_to_the_newest_row_per_user(spark, root):
    warehouse, name = Warehouse(spark, root), "gold_live_leaderboard"
    warehouse.write_changes(board(spark, ("a", 1), ("b", 1)), name, 0)
    warehouse.write_changes(board(spark, ("a", 2)), name, 1)
    assert current(warehouse) == [("a", 2), ("b", 1)]
    warehouse.write_changes(board(spark, ("a", 2)), name, 1)  # replay of a batch
    assert current(warehouse) == [("a", 2), ("b", 1)]
    warehouse.fold_changes(name, 1)
    assert current(warehouse) == [("a", 2), ("b", 1)]
    for batch in range(2, 12):  # two-digit numbers order as numbers
        warehouse.write_changes(board(spark, ("b", batch)), name, batch)
    assert current(warehouse) == [("a", 2), ("b", 11)]
    begun = warehouse.read_current(name)
    warehouse.fold_changes(name, 11)
    assert current(warehouse) == [("a", 2), ("b", 11)]
    assert begun.count() == 2
    warehouse.write_changes(board(spark, ("c", 1)), name, 12)
    warehouse.fold_changes(name, 12)
    assert current(warehouse) == [("a", 2), ("b", 11), ("c", 1)]
    folder = warehouse.stream_path(name)
    assert warehouse.numbered(f"{folder}/base", "as_of=") == [11, 12]
    assert warehouse.numbered(f"{folder}/changes", "batch_id=") == [12]


def test_a_new_generation_starts_empty_and_the_old_stays(spark, root):
    warehouse, name = Warehouse(spark, root), "gold_live_leaderboard"
    warehouse.write_changes(board(spark, ("a", 1)), name, 0)
    assert warehouse.open_generation() == 1
    assert current(warehouse) == []
    warehouse.write_changes(board(spark, ("b", 1)), name, 0)
    assert current(warehouse) == [("b", 1)]


def test_dimension_reader_names_the_key_and_prunes(spark, tmp_path):
    rows = [("prob_1", "Graph walk", "graphs", "Easy", 1000, "inst_1", "Ann")]
    path = str(tmp_path / "problems")
    spark.createDataFrame(rows, schemas.DIMENSIONS["problems"]).write.json(path)
    df = read_dimension(spark, "problems", path, ("problem_id", "category"), file_format="json")
    assert [tuple(r) for r in df.collect()] == [("prob_1", "graphs")]
    assert "ReadSchema: struct<_id:string,category:string>" in df._jdf.queryExecution().executedPlan().toString()


def test_row_counts(spark, root):
    warehouse = Warehouse(spark, root)
    warehouse.write_snapshot(scores(spark, ("a", 1)), SCORES)
    got = {r.table_name: r.rows for r in warehouse.row_counts([SCORES, "gold_system_alerts"]).collect()}
    assert got == {SCORES: 1, "gold_system_alerts": 0}
