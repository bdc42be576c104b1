"""SentencePiece ids by chunks, and line dedup over runs."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from learnlens.llm import line_runs, piece_table
from learnlens.llm.queries import oracle_sql

MODEL = path("piece_bpe_32k.model")
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    ids = PROCESSOR.encode(text or "", add_eos=True)
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(PROCESSOR.decode(ids))


def by_key(rows):
    return sorted(map(tuple, rows), key=str)


def test_pieces_are_the_library_s(small, small_rows, scratch):
    got = piece_table.digests(small, scratch, MODEL).collect()
    assert by_key(got) == by_key(expected(d, t) for d, t in small_rows.items())


def test_pieces_of_awkward_texts(awkward, scratch):
    got = piece_table.digests(awkward, scratch, MODEL).collect()
    assert by_key(got) == by_key(expected(r["doc_id"], r["text"]) for r in awkward.collect())


def test_ids_are_joined_back(awkward, scratch):
    got = piece_table.encode(awkward, scratch, MODEL).collect()
    want = [(r["doc_id"], PROCESSOR.encode(r["text"] or "", add_eos=True)) for r in awkward.collect()]
    assert by_key(got) == by_key(want)


def test_pieces_of_nothing(nothing, scratch):
    assert piece_table.digests(nothing, scratch, MODEL).collect() == []


@given(st.text(st.sampled_from("ab▁ \n\t\xa0é日\x00"), max_size=25))
@settings(max_examples=500, deadline=None)
def test_chunks_carry_the_whole_text(text):
    ids = []
    for chunk in piece_table.chunks(text):
        ids += PROCESSOR.encode(chunk.decode()) if chunk else [PROCESSOR.piece_to_id("▁")]
    assert ids == PROCESSOR.encode(text)


# lines ---------------------------------------------------------------------------------


def plain_dedup(rows, min_chars=10):
    """Straight from the rule: rows of (doc_id, text)."""
    rows = [(d, (t or "").encode().split(b"\n")) for d, t in rows]
    first, holders = {}, {}
    for d, lines in rows:
        own = line_runs.NO_ID if d is None else d
        for line in lines:
            key = line.strip(b" \t\n\x0b\x0c\r").lower()
            if len(key.decode()) >= min_chars:
                first[key] = min(first.get(key, own), own)
                holders.setdefault(key, set()).add(own)
    out = []
    for d, lines in rows:
        own = line_runs.NO_ID if d is None else d
        keys = [line.strip(b" \t\n\x0b\x0c\r").lower() for line in lines]
        kept = [n for n, k in zip(lines, keys, strict=True) if k not in first or first[k] == own]
        out.append((d, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return out


def result(df):
    return by_key(df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect())


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_lines_go_by_the_rule(small, small_rows, scratch, batches, fanout):
    got = line_runs.deduplicate(small, scratch, batches=batches, fanout=fanout, buckets=4)
    assert result(got) == by_key(plain_dedup(small_rows.items()))


def test_lines_of_awkward_texts(awkward, scratch):
    got = line_runs.deduplicate(awkward, scratch, batches=3, buckets=4)
    assert set(awkward.columns) <= set(got.columns)
    assert result(got) == by_key(plain_dedup((r["doc_id"], r["text"]) for r in awkward.collect()))


def test_lines_of_nothing(nothing, scratch):
    assert line_runs.deduplicate(nothing, scratch).collect() == []


def test_text_and_length_follow_the_kept_lines(awkward, scratch):
    got = line_runs.shortened(awkward, scratch, buckets=4)
    assert got.columns == awkward.columns
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])


def test_runs_are_levelled(spark, scratch):
    store = line_runs.LineRuns(spark, scratch.path("runs"), buckets=2, fanout=2)
    for i in range(5):
        rows = [(f"k{j}".encode(), i) for j in range(i, i + 3)]
        store.ingest(spark.createDataFrame(rows, "key binary, owner long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert {bytes(r["key"]): r["owner"] for r in store.owners().collect()} == {
        b"k0": 0, b"k1": 0, b"k2": 0, b"k3": 1, b"k4": 2, b"k5": 3, b"k6": 4
    }


def test_a_run_is_read_without_a_shuffle(spark, scratch):
    store = line_runs.LineRuns(spark, scratch.path("runs"), buckets=4, fanout=9)
    rows = [(f"k{j}".encode(), 0) for j in range(50)]
    store.ingest(spark.createDataFrame(rows, "key binary, owner long"))
    batch = spark.createDataFrame(rows, "key binary, owner long").groupBy("key").min("owner")
    plan = store.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def filled(spark, scratch, runs, buckets=4, fanout=9):
    store = line_runs.LineRuns(spark, scratch.fresh("runs"), buckets, fanout)
    for i in range(runs):
        rows = [(f"k{j}".encode(), i) for j in range(20 * i, 20 * i + 50)]
        store.ingest(spark.createDataFrame(rows, "key binary, owner long"))
    return store


def test_runs_are_merged_and_looked_up_without_a_shuffle_or_a_sort(spark, scratch):
    store = filled(spark, scratch, 2)
    one, other = store.runs()
    plan = plan_of(store.merged(one, other))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan
    lines = store.store(store.dealt(store.owners().selectExpr("owner", "1L AS mark", "key")))
    plan = plan_of(line_runs.owned(store, lines, store.compact()))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan


def test_only_the_batch_is_sorted_for_an_anti_join(spark, scratch):
    store = filled(spark, scratch, 2)
    lines = store.store(store.dealt(store.owners().selectExpr("owner", "1L AS mark", "key")))
    plan = plan_of(store.unseen(store.table(lines).groupBy("key").min("owner")))
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and plan.count("Sort ") <= 1


@pytest.mark.parametrize("tasks", [8, 211])
def test_a_run_is_one_file_a_bucket(spark, scratch, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        store = line_runs.LineRuns(spark, scratch.fresh("runs"), buckets=8)
        rows = spark.range(5000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS key", "id AS owner")
        for part in range(3):
            store.ingest(rows.filter(f"id % 3 = {part}"))
        for run in store.runs():
            assert len(store.table(run).inputFiles()) == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merged_runs_leave_nothing_behind(spark, scratch):
    before = {t.name for t in spark.catalog.listTables()}
    store = filled(spark, scratch, 4, fanout=2)
    folder = spark._jvm.java.io.File(store.root.removeprefix("file:"))
    assert len(store.runs()) == len(folder.list()) == len(store.paths) == 1
    store.remove()
    assert len(folder.list()) == 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_line_in_most_documents_and_many_rows_without_an_id(spark, scratch):
    common = "this line is in nearly every document"
    rows = [(i, f"{common}\nthe own line of document {i}\nx") for i in range(300)]
    rows += [(None, f"{common}\nanother line number {i}") for i in range(50)] + [(None, f"{common}\nanother line number 7")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_runs.deduplicate(table, scratch, batches=3, buckets=4)
    assert result(got) == by_key(plain_dedup(rows))


def test_sql_is_given_for_lines():
    assert "op4_line_runs" in oracle_sql()
