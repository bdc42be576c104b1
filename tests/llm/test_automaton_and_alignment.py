"""The tokenization automaton, minimal perfect hashing and cross-tokenizer alignment."""

import hashlib
from collections import Counter, defaultdict
from functools import cache
from itertools import pairwise

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from learnlens.llm import alignment, merge_automaton
from learnlens.llm.perfect_hash import PerfectHash

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@cache
def library(name):
    return Tokenizer.from_file(path(name))


@cache
def own(name):
    return merge_automaton.Tokenizer(path(name))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def merged(word, merges):
    """Merges by their order, each from the left, one after another."""
    tokens = list(word)
    for u, v in merges:
        at = 0
        while at + 1 < len(tokens):
            if (tokens[at], tokens[at + 1]) == (u, v):
                tokens[at : at + 2] = [u + v]
            at += 1
    return tokens


@st.composite
def merge_lists(draw):
    made, merges = list("ab"), []
    for _ in range(draw(st.integers(0, 12))):
        pair = draw(st.tuples(st.sampled_from(made), st.sampled_from(made)))
        if pair[0] + pair[1] not in made:
            made.append(pair[0] + pair[1])
            merges.append(pair)
    return merges


@given(merges=merge_lists(), word=st.text("ab", min_size=1, max_size=24))
@settings(max_examples=1000, deadline=None)
def test_the_automaton_accepts_what_the_merges_make(merges, word):
    names = [*"ab", *(u + v for u, v in merges)]
    automaton = merge_automaton.Automaton("ab", merges, {n: i for i, n in enumerate(names)})
    assert [names[i] for i in automaton.encode(word)] == merged(word, merges)


@pytest.mark.parametrize("bad", [[("a", "b"), ("a", "bc")], [("a", "a"), ("a", "aa"), ("aa", "a")]])
def test_merges_that_no_automaton_takes(bad):
    with pytest.raises((ValueError, KeyError)):
        merge_automaton.Automaton("abc", bad, {n: i for i, n in enumerate("abc")})


@pytest.mark.parametrize("name", FILES)
@given(text=st.text(st.sampled_from("abeinrst'sé1. \n\t\xa0\x1c\x85İßΣ日<|"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_and_texts_are_the_library_s(name, text):
    coded = library(name).encode(text, add_special_tokens=False).ids
    ids = own(name).table(1000).ids([text])[0].tolist()
    assert ids == coded
    assert own(name).decode(ids) == library(name).decode(coded, skip_special_tokens=False)


def test_added_tokens_of_the_library():
    texts = ["a<|endoftext|>b", "<|startoftext|> x <|endoftext|><|endoftext|>", "<|endoftext", "A <|ENDOFTEXT|>"]
    ids = own(FILES[0]).table(1000).ids(texts)
    assert [i.tolist() for i in ids] == [library(FILES[0]).encode(t, add_special_tokens=False).ids for t in texts]


def expected_digests(rows):
    out = []
    for doc_id, text in rows:
        ids = library(FILES[0]).encode(text or "", add_special_tokens=False).ids
        text = library(FILES[0]).decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text)))
    return Counter(out)


def test_digests_of_awkward_and_small_tables(awkward, small, nothing, scratch):
    for table in (awkward, small):
        got = merge_automaton.digests(table, scratch, path(FILES[0]), limit=50).collect()
        assert Counter(map(tuple, got)) == expected_digests((r["doc_id"], r["text"]) for r in table.collect())
    assert merge_automaton.digests(nothing, scratch, path(FILES[0])).collect() == []


@pytest.mark.parametrize("name", FILES)
def test_texts_are_encoded_and_decoded(awkward, scratch, name):
    coded = merge_automaton.encode(awkward, scratch, path(name))
    assert coded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = Counter((r["doc_id"], r["text"]) for r in merge_automaton.decode(coded, path(name)).collect())
    ids = [(r["doc_id"], library(name).encode(r["text"] or "", add_special_tokens=False).ids) for r in awkward.collect()]
    assert got == Counter((d, library(name).decode(i, skip_special_tokens=False)) for d, i in ids)


# perfect hashing ----------------------------------------------------------------------


@given(st.sets(st.integers(0, 2**64 - 1), max_size=500), st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=200, deadline=None)
def test_every_key_has_its_number_and_strangers_none(keys, others):
    array = np.array(sorted(keys), np.uint64)
    for function in (one := PerfectHash(array), PerfectHash.from_bytes(one.to_bytes())):
        assert sorted(function(array).tolist()) == list(range(len(keys)))
        found = function(np.array(others, np.uint64))
        assert [bool(n >= 0) for n in found] == [o in keys for o in others]


def test_keys_that_differ_in_few_bits():
    array = np.arange(200_000, dtype=np.uint64) << np.uint64(32)
    function = PerfectHash(array)
    assert np.array_equal(np.sort(function(array)), np.arange(200_000))
    assert sum(map(len, function.levels)) < 4 * 200_000  # bits, the table of keys apart


# alignment ----------------------------------------------------------------------------

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@cache
def aligners():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    letters = alignment.byte_letters()
    back = {c: bytes([i]) for i, c in enumerate(letters)}
    names = {i: n for n, i in first.get_vocab(with_added_tokens=False).items()}
    return first, {i: b"".join(back[c] for c in n) for i, n in names.items()}, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_force(documents):
    """The contract, offset by offset."""
    first, spelled, second = aligners()
    links_of, out, held = [], [], Counter()
    for doc_id, text in documents:
        links, groups, a, b = [], [], [], []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            in_a = [spelled[i] for i in a]
            in_b = [
                bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in zip(b, map(second.id_to_piece, b), strict=True)
            ]
            if not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
                a, b, in_a, in_b = [], [], [], []
            ends_a = np.cumsum([0, *map(len, in_a)]).tolist()
            ends_b = np.cumsum([0, *map(len, in_b)]).tolist()
            for i, (x, y) in enumerate(pairwise(ends_a)):
                links += [(a[i], b[j]) for j, (u, v) in enumerate(pairwise(ends_b)) if x < v and u < y] if len(a) < 500 else []
            if len(a) >= 500:
                j = 0
                for i, (x, y) in enumerate(pairwise(ends_a)):
                    while ends_b[j + 1] <= x:
                        j += 1
                    k = j
                    while k < len(b) and ends_b[k] < y:
                        links.append((a[i], b[k]))
                        k += 1
            both = sorted(set(ends_a) & set(ends_b))
            places_a, places_b = ({e: i for i, e in enumerate(ends)} for ends in (ends_a, ends_b))
            for x, y in pairwise(both):
                left, right = a[places_a[x] : places_a[y]], b[places_b[x] : places_b[y]]
                groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
        held.update(set(links))
        links_of.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for doc_id, n_a, n_b, n_groups, links, groups in links_of:
        n_best = sum(held[link] == best[link[0]] for link in links)
        out.append(
            (doc_id, n_a, n_b, n_groups, len(links), n_best, sum(held[link] for link in links), sha(groups) if groups else "")
        )
    return Counter(out)


def test_alignment_by_brute_force(awkward, small, nothing, scratch, monkeypatch):
    for table in (awkward, small):
        got = alignment.align(table, scratch, A, B).collect()
        assert Counter(map(tuple, got)) == brute_force([(r["doc_id"], r["text"]) for r in table.collect()])
    assert alignment.align(nothing, scratch, A, B).collect() == []


def test_many_blocks_twigs_and_forks(small, small_rows, scratch, monkeypatch):
    blocks = small.repartition(24)
    monkeypatch.setattr(alignment, "TWIG", 1)
    monkeypatch.setattr(alignment, "FORK", 3)
    got = alignment.align(blocks, scratch, A, B, whole=True).collect()
    assert Counter((*r[:7], r["groups_sha256"]) for r in got) == brute_force(small_rows.items())
    assert all(r["groups_sha256"] == (sha(r["groups"]) if r["groups"] else "") for r in got)


def test_texts_without_tokens_and_very_long_ones(spark, scratch):
    rows = [(1, None), (None, ""), (2, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.align(table, scratch, A, B).collect()
    assert Counter(map(tuple, got)) == Counter([(d, 0, 0, 0, 0, 0, 0, "") for d, _ in rows])
    empty = sha(b"")
    assert {tuple(r)[1:] for r in merge_automaton.digests(table, scratch, path(FILES[0])).collect()} == {(0, empty, empty)}
    rows = [(1, "x" * 200_000), (2, "word " * 40_000), (3, "\n" * 20_000), (4, "é" * 30_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, alignment.align(table, scratch, A, B).collect())) == brute_force(rows)
    got = merge_automaton.digests(table, scratch, path(FILES[0])).collect()
    assert Counter(map(tuple, got)) == expected_digests(rows)


def test_pairs_and_their_documents(spark, scratch):
    rows = [(1, "the cat"), (2, "the cat the cat"), (3, "a cat"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    first, _, second = aligners()
    found = {(r["first_id"], r["second_id"]): (r["documents"], r["best"]) for r in alignment.counts(table, scratch, A, B).collect()}
    cat = (first.encode(" cat").ids[0], second.encode("cat")[0])
    assert found[cat] == (3, True)
    assert found[(first.encode(" the").ids[0], second.encode("the")[0])] == (2, True)


def test_a_block_needs_few_bytes_for_each_link():
    import tracemalloc

    a, b = alignment.Bytes([b"x" * n for n in range(1, 51)]), alignment.Bytes([b"x" * n for n in range(1, 41)])
    random = np.random.default_rng(3)
    sizes, firsts, seconds = [], [], []
    for _ in range(40):
        first = random.integers(0, 50, 5000, dtype=np.uint32)
        ends = int(a.lengths[first].sum())
        second = random.integers(0, 40, 9000, dtype=np.uint32)
        stops = np.cumsum(b.lengths[second])
        second = second[: int(np.searchsorted(stops, ends - 40))]
        rest = ends - int(b.lengths[second].sum())
        filled = [min(rest - at, 40) for at in range(0, rest, 40)]
        second = np.concatenate([second, np.array(filled, np.uint32) - np.uint32(1)])
        sizes += len(first), len(second)
        firsts.append(first)
        seconds.append(second)
    tracemalloc.start()
    one = alignment.Alignment(np.array(sizes), np.concatenate(firsts), np.concatenate(seconds), a, b)
    keys, documents = one.distinct()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * len(one.pairs)  # 70 a link before
    held = np.repeat(np.arange(40), np.diff(one.link_stops, prepend=0))
    brute = Counter(p for _, p in set(zip(held.tolist(), one.keys(one.pairs).tolist(), strict=True)))
    assert dict(zip(keys.tolist(), documents.tolist(), strict=True)) == brute


def test_the_ids_of_a_task_are_written_as_they_come(small, scratch):
    alignment.align(small, scratch, A, B)
    written = scratch.spark.read.parquet(scratch.path("encoded"))
    assert not any("kind=" in name for name in written.inputFiles())  # folders by kind sort every task's ids
