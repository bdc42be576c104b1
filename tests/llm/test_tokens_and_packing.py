"""Token ids, packing and coded id files."""

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from learnlens.llm import packing, rans, tokens
from learnlens.llm.shared import even_keys
from learnlens.llm.tokens import ChunkTable, hugging_table

FILES = [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "blanks")]


@cache
def plain(name):
    tokenizer = Tokenizer.from_file(path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,kind", FILES)
def test_chunked_ids_are_the_tokenizer_s(name, kind, awkward, small_rows):
    texts = [r["text"] for r in awkward.collect()] + list(small_rows.values())
    encode = plain(name)
    for got, text in zip(hugging_table(path(name), kind).ids(texts), texts, strict=True):
        assert got.tolist() == encode(text)


@pytest.mark.parametrize("name,kind", FILES)
@given(text=st.text(st.sampled_from("ab'sé1. \n\t\xa0 \x1c\x85́İß"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_chunked_ids_of_any_white_space(name, kind, text):
    assert hugging_table(path(name), kind).ids([text])[0].tolist() == plain(name)(text)


ADDED = ["<|endoftext|>", "<|startoftext|>"]


@pytest.mark.parametrize("name,kind", FILES)
@given(parts=st.lists(st.sampled_from([*ADDED, " ", "one", "'s", "\n", "É", "<|", "end", "."]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_added_tokens_are_found_where_the_library_finds_them(name, kind, parts):
    text = "".join(parts)
    assert hugging_table(path(name), kind).ids([text])[0].tolist() == plain(name)(text)


def test_added_tokens_can_be_ordinary_text():
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = ["one<|endoftext|>two", "<|endoftext|>", "a <|endoftext|><|endoftext|> b"]
    table = hugging_table(path("byte_bpe_50k.json"), "byte_level", as_text=True)
    assert [x.tolist() for x in table.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_table_keeps_what_is_used_most():
    words = hugging_table(path("byte_bpe_50k.json"), "byte_level")
    asked = []

    def encode(batch):
        asked.extend(batch)
        return words.encode(batch)

    table, plainly = ChunkTable(encode, words.chunks, 20), plain("byte_bpe_50k.json")
    texts = [f"some common words and rare{i} once{i} seen" for i in range(200)]
    assert [x.tolist() for t in texts for x in table.ids([t])] == [plainly(t) for t in texts]
    assert asked.count("common") == 1 and len(asked) <= 5 * 200
    assert len(table.numbers) <= 20 and len(table.numbers) == table.coded
    shifted = [f"other lines{i % 3} now" for i in range(200)]
    assert [x.tolist() for t in shifted for x in table.ids([t])] == [plainly(t) for t in shifted]


def test_a_full_table_starts_anew():
    table = hugging_table(path("byte_bpe_50k.json"), "byte_level")
    limit, table.limit = table.limit, 3
    try:
        texts = [f"some {i} words {i * 7}" for i in range(50)]
        encode = plain("byte_bpe_50k.json")
        assert [x.tolist() for t in texts for x in table.ids([t])] == [encode(t) for t in texts]
    finally:
        table.limit = limit


@given(text=st.text(st.sampled_from("abT'sé×À09.,!< \n\x1c\x85\xa0\u0308\u0338ſKİ中²"), max_size=12))
@settings(max_examples=500, deadline=None)
def test_cuts_between_letters_digits_and_marks_keep_the_ids(text):
    name = "word_bpe_49k.json"
    assert hugging_table(path(name), "blanks").ids([text])[0].tolist() == plain(name)(text)


def counted(table):
    """Replaces the table's dictionary: what it is asked for, and what is walked over."""
    asked, walked = [], []

    class Counting(defaultdict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

        def __iter__(self):
            return (walked.append(key) or key for key in super().__iter__())

        def __reversed__(self):
            return (walked.append(key) or key for key in super().__reversed__())

    table.numbers = Counting(None, table.numbers)
    table.numbers.default_factory = table.numbers.__len__
    return asked, walked


def test_new_chunks_are_found_without_a_walk_over_the_table():
    words = hugging_table(path("byte_bpe_50k.json"), "byte_level")
    table, plainly = ChunkTable(words.encode, words.chunks), plain("byte_bpe_50k.json")
    table.ids([f"word{i}" for i in range(1000)])
    _, walked = counted(table)
    texts = [f"another{i} word{i}" for i in range(20)]
    assert [x.tolist() for t in texts for x in table.ids([t])] == [plainly(t) for t in texts]
    assert len(walked) < 100


def test_a_group_of_texts_asks_once_for_each_distinct_chunk(monkeypatch):
    words = hugging_table(path("word_bpe_49k.json"), "blanks")
    table, plainly = ChunkTable(words.encode, words.chunks, words=words.words), plain("word_bpe_49k.json")
    asked, _ = counted(table)
    texts = ["Common words, and <|endoftext|> more\n", None, "", "common Words"] * 500
    want = [plainly(t) for t in texts]
    assert [x.tolist() for x in table.ids(texts)] == want
    assert len(asked) == len(set(asked)) == 6
    monkeypatch.setattr(tokens, "GROUP_BYTES", 100)
    table.limit = 3
    assert [x.tolist() for x in table.ids(texts)] == want
    assert len(table.numbers) <= 3


def check_packed(rows, documents, capacity):
    """Every piece once, gapless sequences within capacity; the number of sequences."""
    encode = plain("byte_bpe_50k.json")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    expected = defaultdict(list)
    for doc_id, text in documents:
        ids = [*encode(text), 2]
        for number, (start, length) in enumerate(packing.pieces_of(len(ids), capacity)):
            expected[doc_id].append((number, start, length, crc(ids[start : start + length])))
    got = {
        d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own)
        for d, own in by_doc.items()
    }
    assert got == {d: sorted(own) for d, own in expected.items()}
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_places_every_piece(awkward, scratch, capacity):
    rows = packing.pack(awkward, scratch, path("byte_bpe_50k.json"), capacity=capacity).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()], capacity)


def test_packing_of_the_small_table_is_tight(small, small_rows, scratch):
    rows = packing.pack(small, scratch, path("byte_bpe_50k.json")).collect()
    used = check_packed(rows, small_rows.items(), 1024)
    assert used <= 1.05 * -(-sum(r["length"] for r in rows) // 1024)


def test_packing_of_nothing(nothing, scratch):
    assert packing.pack(nothing, scratch, path("byte_bpe_50k.json")).collect() == []


@given(
    counts=st.dictionaries(st.integers(1, 40), st.integers(1, 200), max_size=25),
    groups=st.integers(1, 50),
    small=st.integers(0, 20),
)
@settings(max_examples=200, deadline=None)
def test_plan_places_every_rank_once(counts, groups, small):
    runs = packing.plan(dict(counts), 40, groups, small)
    ranks, fill = defaultdict(list), defaultdict(list)
    for run in runs:
        for i in range(run.number):
            ranks[run.length].append(run.first + i)
            fill[run.sequence + i // run.each].append((run.offset + i % run.each * run.length, run.length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40


def best_fit_decreasing(pieces, capacity):
    """Piece by piece; the number of sequences."""
    spaces = []
    for length in sorted(pieces, reverse=True):
        at = bisect_left(spaces, length)
        space = spaces.pop(at) if at < len(spaces) else capacity
        insort(spaces, space - length)
    return len(spaces)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_no_more_sequences_than_best_fit_decreasing(spark, scratch, scale):
    documents = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    rows = packing.pack(documents, scratch, path("byte_bpe_50k.json")).collect()
    used = len({r["sequence_id"] for r in rows})
    assert used <= best_fit_decreasing([r["length"] for r in rows], 1024)


@given(counts=st.dictionaries(st.integers(2, 40), st.integers(1, 60), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_configurations_meet_the_demand_within_capacity(counts):
    sizes, demand = packing._grouped(counts, 8)
    assert sum(demand) == sum(counts.values()) and max(sizes) == max(counts)
    configurations, uses = packing._configurations(sizes, demand, 40)
    assert (configurations @ sizes <= 40).all() and (uses >= 0).all()
    assert np.allclose(uses @ configurations, demand)
    assert uses.sum() >= sum(k * v for k, v in counts.items()) / 40 - 1e-6
    value, _ = packing._fullest(sizes, np.linalg.solve(configurations, np.ones(len(sizes))), demand, 40)
    assert value <= 1 + 1e-4  # no configuration would make it better


@given(st.lists(st.integers(0, 300), min_size=1, max_size=4000))
@settings(max_examples=50, deadline=None)
def test_a_block_is_decoded_to_itself(values):
    ids = np.array(values, np.uint32)
    table = rans.Frequencies(np.bincount(ids))
    assert int(table.frequency.sum()) == 1 << rans.BITS
    raw = rans.encode_block(ids, table)
    shared = rans.Frequencies.from_bytes(table.to_bytes())
    assert rans.decode_block(memoryview(raw), shared).tolist() == values
    broken = bytearray(raw)
    broken[-1] ^= 1
    try:  # a changed block never gives other ids
        assert rans.decode_block(memoryview(bytes(broken)), shared).tolist() == values
    except (ValueError, IndexError):
        pass


def test_a_vocabulary_nearly_as_large_as_the_table():
    counts = np.ones((1 << rans.BITS) - 5, np.int64)
    counts[0] = 1 << 40
    table = rans.Frequencies(counts)
    assert int(table.frequency.sum()) == 1 << rans.BITS and table.frequency.min() == 1


def check_ids(rows, documents):
    encode = plain("word_bpe_49k.json")
    coded = [(d, [*encode(t), 2]) for d, t in documents]
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    start, expected = 0, []
    for doc_id, ids in coded:
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected


def test_id_files_are_read_back(small, small_rows, awkward, scratch, spark, monkeypatch):
    files = rans.write_ids(small, scratch, path("word_bpe_49k.json"), "blanks")
    check_ids(rans.read_ids(files).collect(), small_rows.items())


def test_id_files_of_awkward_texts(awkward, scratch):
    files = rans.write_ids(awkward, scratch, path("word_bpe_49k.json"), "blanks")
    # two equal rows of one id: either order is the same
    check_ids(rans.read_ids(files).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])


@pytest.mark.parametrize("number", [1, 7, 200])
def test_even_keys_go_to_a_partition_each(spark, number):
    keys = spark.createDataFrame([(k,) for k in even_keys(spark, number)], "k long")
    found = keys.repartition(number, "k").select(F.spark_partition_id().alias("p")).collect()
    assert len(found) == len({r["p"] for r in found}) == number


def test_rows_without_an_id_are_in_many_files(spark, scratch):
    rows = [(None, f"text number {i} without an id") for i in range(100)] + [(i, f"word {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = rans.write_ids(df, scratch, path("word_bpe_49k.json"), "blanks")
    assert files.filter("first IS NULL").count() > 1
    got = sorted(rans.read_ids(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 100 + list(range(30))
    at = 0
    for r in got:  # gapless
        assert r["start"] == at
        at += r["n_tokens"]
    encode = plain("word_bpe_49k.json")
    assert sorted(r["ids_crc32"] for r in got) == sorted(crc([*encode(t), 2]) for _, t in rows)
    with pytest.raises(ValueError, match="distinct tokens"):
        rans.Frequencies(np.ones((1 << rans.BITS) + 1, np.int64))


def test_id_files_of_nothing(nothing, scratch):
    files = rans.write_ids(nothing, scratch, path("word_bpe_49k.json"), "blanks")
    assert rans.read_ids(files).collect() == []


def test_spans_and_blocks_split_long_documents(tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 64)
    monkeypatch.setattr(rans, "SPAN", 200)
    random = np.random.default_rng(1)
    docs = [(i, random.integers(0, 50, n).astype(np.uint32)) for i, n in enumerate([5, 1000, 1, 63, 64, 65, 300])]
    table = rans.Frequencies(np.bincount(np.concatenate([d for _, d in docs])))
    writer = rans._FileWriter(f"file://{tmp_path}", table)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    footer = rans.read_footer(f"file://{tmp_path}", writer.name)
    got = []
    for span in footer["spans"]:
        parts = rans.read_span(f"file://{tmp_path}", writer.name, span, table)
        got += [(d, ids.tolist()) for d, ids in zip(span["docs"], parts, strict=True)]
    assert len(footer["spans"]) > 1 and got == [(d, ids.tolist()) for d, ids in docs]
