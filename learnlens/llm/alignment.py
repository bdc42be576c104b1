"""Cross-tokenizer alignment with counts of linked id pairs.

Two tokenizers cut one text into bytes.  Offsets where tokens of both end cut the tokens into groups,
and two tokens are linked where their byte ranges overlap.  A pair of ids counts once for each document
that holds it linked, over the whole corpus.

1. Texts are encoded, block by block, and the ids of a block are written.  Each block is aligned and sends
   its distinct pairs, with the number of its documents that hold each, to shards: a pair goes where
   the hash of its first id says, so a shard holds all pairs of its ids.
2. A shard's distinct pairs get a minimal perfect hash.  Blocks add their numbers into dense vectors, indexed by
   hash, one for each twig of blocks; the vectors are summed up a tree to one for each shard, and the
   highest count of each first id is marked.
3. The shards answer each block's pairs in their order, each key verified.  The second pass aligns the block's
   ids anew and looks the counts up.

A block asks for a pair once, however common it is.  The pairs of a shard are bounded by the two vocabularies,
and a task holds one block, or the table of one shard.

Defined results: a text that is null or empty, or whose joined bytes differ from what was encoded under either
tokenizer, has no tokens, zeros, and the groups ''; rows with equal or null doc_ids are separate documents;
an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.llm import piece_table
from learnlens.llm.perfect_hash import PerfectHash
from learnlens.llm.shared import Scratch, packed, rows_of, text_rows, unpacked
from learnlens.llm.tokens import ChunkTable, byte_letters, hugging_table

SHARDS = 64  # parts of the first tokenizer's vocabulary
BLOCK_BYTES = 4 << 20
TWIG = 64  # blocks that add into one dense vector
FORK = 8  # vectors that are summed at a time
CHUNKS = 100_000  # distinct chunks that a task remembers of each tokenizer
LINKS = 1 << 18  # that are told apart by document at a time

TABLE, ASK, DOCS = 0, 1, 2
_ROW = pa.schema(
    [
        ("block", pa.int64()),
        ("shard", pa.int32()),
        ("kind", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.binary()),  # of each document: tokens of the first, of the second tokenizer
        ("first", pa.binary()),
        ("second", pa.binary()),
        ("keys", pa.binary()),
        ("counts", pa.binary()),
    ]
)
_DDL = (
    "block long, shard int, kind int, doc_ids array<long>, sizes binary, first binary, second binary, "
    "keys binary, counts binary"
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ROW], schema=_ROW)


class Bytes:
    """What each id of a tokenizer stands for."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))

    def spell(self, ids: np.ndarray, text: str) -> bool:
        """Whether the joined bytes are those of the text.

        Both tokenizers keep every byte but the marker's, which piece models read as a space, so the
        number of bytes tells for a text without one.
        """
        data = text.encode()
        if int(self.lengths[ids].sum()) != len(data):
            return False
        return "\u2581" not in text or b"".join(map(self.entries.__getitem__, ids.tolist())) == data


def byte_level_bytes(path: str) -> Bytes:
    """Entries of a byte-level vocabulary; added tokens stand for their content."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    back = {letter: bytes([byte]) for byte, letter in enumerate(byte_letters())}
    added = tokenizer.get_added_tokens_decoder()
    entries = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for name, i in tokenizer.get_vocab(with_added_tokens=True).items():
        entries[i] = name.encode() if i in added else b"".join(map(back.__getitem__, name))
    return Bytes(entries)


def piece_bytes(path: str) -> Bytes:
    processor = piece_table._model(path)
    entries = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        byte = bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode()
        entries.append(byte)
    return Bytes(entries)


def _piece_table(path: str) -> ChunkTable:
    piece_table.check_model(path)
    processor = piece_table._model(path)
    lone = [processor.piece_to_id("▁")]

    def encode(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = processor.encode([c.decode() for c in batch], num_threads=1)
        found = [ids if chunk else lone for chunk, ids in zip(batch, found, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    return ChunkTable(encode, piece_table.chunks, CHUNKS)


class Alignment:
    """The documents of a block, aligned.

    Documents follow each other: the bytes under both tokenizers are the same, so offsets go on from
    one document to the next.
    """

    def __init__(self, sizes: np.ndarray, first: np.ndarray, second: np.ndarray, a: Bytes, b: Bytes):
        self.first, self.second, sizes = first, second, sizes.astype(np.int64)
        self.first_stops, self.second_stops = np.cumsum(sizes[0::2]), np.cumsum(sizes[1::2])
        # offsets and places in 32 bits, unless a text is too long for that
        size = int(a.lengths[first].sum())
        index = np.int32 if size < 1 << 31 else np.int64
        first_ends, second_ends = np.cumsum(a.lengths[first], dtype=index), np.cumsum(b.lengths[second], dtype=index)
        marks = np.zeros(size + 1, np.uint8)
        marks[first_ends] = 1
        marks[second_ends] += 2
        # between two neighbouring offsets lies one token of each: a link
        cuts = np.flatnonzero(marks).astype(index)
        marks = marks[cuts]
        ends = np.where(self.first_stops > 0, first_ends[self.first_stops - 1], 0) if size else 0 * self.first_stops
        self.link_stops = np.searchsorted(cuts, ends.astype(index), side="right")
        del first_ends, second_ends, cuts
        self.ends_first, self.ends_second, both = (marks & 1).astype(bool), marks > 1, marks == 3
        self.link_first = np.cumsum(self.ends_first, dtype=index) - self.ends_first
        self.link_second = np.cumsum(self.ends_second, dtype=index) - self.ends_second
        self.link_group = np.cumsum(both, dtype=index) - both
        self.groups = int(both.sum())
        self.group_stops = np.concatenate([[0], np.cumsum(both)])[self.link_stops]
        # ids of both in one number, as short as they allow
        shift = np.int64(len(b.entries)).item().bit_length()
        self.short = shift + np.int64(len(a.entries)).item().bit_length() <= 32
        kind, self.shift = np.uint32 if self.short else np.uint64, 32 if not self.short else shift
        self.pairs = first[self.link_first].astype(kind) << kind(self.shift) | second[self.link_second].astype(kind)

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs with the first id in the upper half of 64 bits."""
        wide = pairs.astype(np.uint64)
        low = np.uint64((1 << self.shift) - 1)
        return wide >> np.uint64(self.shift) << np.uint64(32) | wide & low

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, and how many documents hold each."""
        pairs = np.unique(self.pairs)
        documents, stops, at = np.zeros(len(pairs), np.int64), self.link_stops, 0
        while at < len(stops):  # whole documents, about LINKS links at a time
            begin = int(stops[at - 1]) if at else 0
            last = max(int(np.searchsorted(stops, begin + LINKS, side="right")), at + 1)
            code = np.searchsorted(pairs, self.pairs[begin : int(stops[last - 1])])
            document = np.repeat(np.arange(last - at), np.diff(stops[at:last], prepend=begin))
            held = np.unique(document * len(pairs) + code)
            documents += np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
            at = last
        return self.keys(pairs), documents

    def counted(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The count of each link's pair; ``keys`` ascend and hold all pairs."""
        if not len(keys):
            return np.empty(0, np.int64)
        low = (keys >> np.uint64(32) << np.uint64(self.shift)) | (keys & np.uint64(0xFFFFFFFF))
        return counts[np.searchsorted(low.astype(self.pairs.dtype), self.pairs)]

    def pieces(self, a: Bytes, b: Bytes) -> np.ndarray:
        """The tokens of all groups in writing order, as numbers of ``_written``."""
        of_first, of_second = self.link_group[self.ends_first], self.link_group[self.ends_second]
        n_first, n_second = np.bincount(of_first, minlength=self.groups), np.bincount(of_second, minlength=self.groups)
        first_stops, second_stops = np.cumsum(n_first), np.cumsum(n_second)
        out = np.empty(len(self.first) + len(self.second), np.int32)
        # a token has before it the tokens of earlier groups, those of the second behind those of the first
        first, second = self.first.astype(np.int32), self.second.astype(np.int32) + 2 * len(a.entries)
        first[first_stops - 1] += len(a.entries)  # every group ends both
        second[second_stops - 1] += len(b.entries)
        out[np.arange(len(first)) + (second_stops - n_second)[of_first]] = first
        out[np.arange(len(second)) + first_stops[of_second]] = second
        return out


def _written(a: Bytes, b: Bytes) -> list[bytes]:
    """Ids with what follows them: a comma, or where a group's tokens end a bar or a semicolon."""
    return [
        f"{i}{mark}".encode() for table, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in range(len(table.entries))
    ]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    first = (keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return ((first >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: their steps, high and low halves."""
    steps = np.diff(keys, prepend=np.uint64(0))
    halves = np.concatenate([steps >> np.uint64(32), steps & np.uint64(0xFFFFFFFF)])
    return packed(halves)


def _unpacked_keys(raw) -> np.ndarray:
    halves = unpacked(raw).astype(np.uint64)
    high, low = halves[: len(halves) // 2], halves[len(halves) // 2 :]
    return np.cumsum(high << np.uint64(32) | low, dtype=np.uint64)


class _Tokenizers:
    """Both tokenizers, in a task."""

    def __init__(self, first: str, second: str):
        self.a, self.b = byte_level_bytes(first), piece_bytes(second)
        self.first = hugging_table(first, "byte_level", as_text=True, limit=CHUNKS)
        self.second = _piece_table(second)

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        spaced = [f" {text}" if text else None for text in texts]
        none = np.empty(0, np.uint32)
        for text, a, b in zip(spaced, self.first.ids(spaced), self.second.ids(texts), strict=True):
            same = text is None or (self.a.spell(a, text) and self.b.spell(b, text))
            yield (a, b) if same else (none, none)


def _encoded(documents: DataFrame, first: str, second: str) -> DataFrame:
    """DOCS of every block, and what it asks of each shard."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _Tokenizers(first, second)
        block = TaskContext.get().partitionId() << 32  # written once, so it stays as it is
        names, sizes, firsts, seconds, held = [], [], [], [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            ids_a, ids_b, lengths = np.concatenate(firsts), np.concatenate(seconds), np.array(sizes)
            row = {"sizes": packed(lengths), "first": packed(ids_a), "second": packed(ids_b)}
            yield _batch([{"block": block, "shard": -1, "kind": DOCS, "doc_ids": names} | row])
            keys, counts = Alignment(lengths, ids_a, ids_b, both.a, both.b).distinct()
            shard = shard_of(keys, SHARDS)
            for number in np.unique(shard).tolist():
                own = shard == number
                row = {"keys": _packed_keys(keys[own]), "counts": packed(counts[own])}
                yield _batch([{"block": block, "shard": number, "kind": ASK} | row])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                doc_ids, texts = zip(*text_rows(iter([batch.slice(at, 500)]), "doc_id", "text"), strict=True)
                for doc_id, text, (a, b) in zip(doc_ids, texts, both.encoded(list(texts)), strict=True):
                    names.append(doc_id)
                    sizes += len(a), len(b)
                    firsts.append(a)
                    seconds.append(b)
                    held += len(text or "") + 64
                    if held >= BLOCK_BYTES:
                        yield from finished()
                        block += 1
                        names, sizes, firsts, seconds, held = [], [], [], [], 0
        if names:
            yield from finished()
        both.first.clear()

    return documents.select("doc_id", "text").mapInArrow(encode, _DDL)


def _grouped(rows: DataFrame, keys: list[str], work: Callable[[Iterator[dict]], Iterator], ddl: str) -> DataFrame:
    """``work`` over the rows of one group at a time, tables first."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches)
        row = next(rows, None)
        while row is not None:
            current, ahead = [row[k] for k in keys], [row]

            def own():
                while ahead[0] is not None and [ahead[0][k] for k in keys] == current:
                    yield ahead[0]
                    ahead[0] = next(rows, None)

            mine = own()
            yield from work(mine)
            for _ in mine:  # what was left unread
                pass
            row = ahead[0]

    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "block").mapInArrow(groups, ddl)


_SUM = pa.schema([("shard", pa.int32()), ("twig", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUM_DDL = "shard int, twig long, kind int, block long, keys binary, counts binary"


def _sum_batch(shard, twig, keys=None, counts=None) -> pa.RecordBatch:
    values = [shard], [twig], [TABLE], [None], [keys], [counts]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SUM, strict=True)], schema=_SUM)


def _dense(vector: np.ndarray) -> bytes:
    """Counts in 64 bits, as two halves."""
    whole = vector.astype(np.uint64)
    return packed(np.concatenate([whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32)]))


def _counts(raw) -> np.ndarray:
    halves = unpacked(raw).astype(np.int64)
    return halves[: len(halves) // 2] + (halves[len(halves) // 2 :] << 32)


def _united(rows: Iterator[dict]) -> tuple[dict | None, np.ndarray]:
    """The distinct keys of rows that each hold some."""
    row, keys, held, size = None, np.empty(0, np.uint64), [], 0
    for row in rows:
        held.append(_unpacked_keys(row["keys"]))
        size += len(held[-1])
        if size > max(1 << 20, len(keys)):
            keys, held, size = np.unique(np.concatenate([keys, *held])), [], 0
    return row, np.unique(np.concatenate([keys, *held]))


def _hashed(asks: DataFrame, scratch: Scratch) -> DataFrame:
    """``(shard, keys)``: the hash function of every shard's distinct pairs."""

    def unite(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        row, keys = _united(own)
        yield _sum_batch(row["shard"], row["twig"], _packed_keys(keys))

    def build(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        row, keys = _united(own)
        yield _sum_batch(row["shard"], None, PerfectHash(keys).to_bytes())

    united = _grouped(asks.select("shard", "twig", "kind", "block", "keys"), ["shard", "twig"], unite, _SUM_DDL)
    built = _grouped(united.select("shard", "kind", "block", "keys"), ["shard"], build, _SUM_DDL)
    return scratch.stage(built.select("shard", "keys"), "functions")


def _summed(asks: DataFrame, functions: DataFrame, twigs: int, scratch: Scratch) -> DataFrame:
    """``(shard, keys, counts)``: the function, and the dense counts with the mark of the highest in their lowest bit."""

    def add(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        table = next(own)
        function, total = PerfectHash.from_bytes(table["keys"]), None
        for ask in own:
            total = np.zeros(len(function), np.int64) if total is None else total
            number = function(_unpacked_keys(ask["keys"]))
            if (number < 0).any():
                raise ValueError("a pair that its shard does not know")
            total[number] += unpacked(ask["counts"])  # keys are distinct
        if total is not None:
            yield _sum_batch(table["shard"], table["twig"], counts=_dense(total))

    def plus(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        row, total = None, None
        for row in own:
            total = _counts(row["counts"]) + (0 if total is None else total)
        yield _sum_batch(row["shard"], row["twig"], counts=_dense(total))

    def mark(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        rows = list(own)  # the function and one vector
        function = PerfectHash.from_bytes(next(r["keys"] for r in rows if r["keys"] is not None))
        total = _counts(next(r["counts"] for r in rows if r["counts"] is not None))
        _, first = np.unique(function.keys >> np.uint64(32), return_inverse=True)
        highest = np.zeros(int(first.max(initial=-1)) + 1, np.int64)
        np.maximum.at(highest, first, total)
        marked = total * 2 + (total == highest[first])
        yield _sum_batch(rows[0]["shard"], None, function.to_bytes(), _dense(marked))

    none = F.lit(None)
    sent = functions.select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(twigs - 1).cast("long"))).alias("twig"),
        F.lit(TABLE).alias("kind"), none.cast("long").alias("block"), "keys", none.cast("binary").alias("counts"),
    )
    rows = asks.select("shard", "twig", "kind", "block", "keys", "counts").unionByName(sent)
    sums = _grouped(rows, ["shard", "twig"], add, _SUM_DDL)
    while twigs > 1:
        twigs = -(-twigs // FORK)
        sums = _grouped(sums.withColumn("twig", F.col("twig") % twigs), ["shard", "twig"], plus, _SUM_DDL)
    whole = sums.select("shard", "kind", "block", none.cast("binary").alias("keys"), "counts").unionByName(
        sent.filter("twig = 0").select("shard", "kind", "block", "keys", "counts")
    )
    return scratch.stage(_grouped(whole, ["shard"], mark, _SUM_DDL).select("shard", "keys", "counts"), "counts")


def _answers(asks: DataFrame, tables: DataFrame, twigs: int) -> DataFrame:
    """ASK rows with the marked counts of their keys, in their order."""

    def answer(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        table = next(own)
        function, marked = PerfectHash.from_bytes(table["keys"]), _counts(table["counts"])
        for ask in own:
            number = function(_unpacked_keys(ask["keys"]))
            if (number < 0).any():
                raise ValueError("a pair that its shard does not know")
            row = {"keys": bytes(ask["keys"]), "counts": _dense(marked[number])}
            yield _batch([{"block": ask["block"], "shard": ask["shard"], "kind": ASK} | row])

    sent = tables.select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(twigs - 1).cast("long"))).alias("twig"),
        F.lit(TABLE).alias("kind"), F.lit(None).cast("long").alias("block"), "keys", "counts",
    )
    rows = asks.select("shard", "twig", "kind", "block", "keys", "counts").unionByName(sent)
    return _grouped(rows, ["shard", "twig"], answer, _DDL)


_RESULT = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups", pa.string()), ("groups_sha256", pa.string())]
)


def _looked_up(docs: DataFrame, answers: DataFrame, first: str, second: str, whole: bool) -> DataFrame:
    """The second pass: each block is aligned anew and its pairs are looked up."""
    schema = pa.schema([f for f in _RESULT if whole or f.name != "groups"])
    kinds = {"int64": "long", "string": "string"}
    ddl = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)

    def look(batches: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        a, b = _bytes_of(first, byte_level_bytes), _bytes_of(second, piece_bytes)
        written = _bytes_of((first, second), lambda _: _written(a, b))
        keys, marked, got = [], [], None
        for got in batches:
            if got["kind"] == ASK:
                keys.append(_unpacked_keys(got["keys"]))
                marked.append(_counts(got["counts"]))
        if got is None or got["kind"] != DOCS:
            return
        sizes = unpacked(got["sizes"])
        one = Alignment(sizes, unpacked(got["first"]), unpacked(got["second"]), a, b)
        keys = np.concatenate([np.empty(0, np.uint64), *keys])
        order = np.argsort(keys)
        marked = one.counted(keys[order], np.concatenate([np.empty(0, np.int64), *marked])[order])

        def each(stops: np.ndarray, values: np.ndarray) -> np.ndarray:
            """Sums of the values of each document."""
            total = np.concatenate([[0], np.cumsum(values)])[stops]
            return np.diff(total, prepend=0)

        columns = [
            sizes[0::2], sizes[1::2], np.diff(one.group_stops, prepend=0), np.diff(one.link_stops, prepend=0),
            each(one.link_stops, marked & 1), each(one.link_stops, marked >> 1),
        ]
        codes, groups, digests, at = one.pieces(a, b), [], [], 0
        for stop in (one.first_stops + one.second_stops).tolist():
            group = b"".join(map(written.__getitem__, codes[at:stop].tolist()))[:-1]
            digests.append(hashlib.sha256(group).hexdigest() if group else "")
            if whole:
                groups.append(group.decode())
            at = stop
        made = [got["doc_ids"], *columns, *([groups] if whole else []), digests]
        for begin in range(0, len(digests), 2000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[begin : begin + 2000], f.type) for c, f in zip(made, schema, strict=True)], schema=schema
            )

    return _grouped(docs.unionByName(answers), ["block"], look, ddl)


_TABLES: dict = {}


def _bytes_of(key, make):
    """What follows from a vocabulary alone, once in each Python worker."""
    if key not in _TABLES:
        _TABLES[key] = make(key)
    return _TABLES[key]


def align(documents: DataFrame, scratch: Scratch, first: str, second: str, whole: bool = False) -> DataFrame:
    """Per document the numbers of tokens, groups and links, of links whose pair has the highest count of its
    first id, and the sum of the counts; the digest of its groups, and with ``whole`` the groups.

    ``first``: a byte-level file, which reads a space and the text; ``second``: a piece model, which adds
    that space itself.
    """
    rows = scratch.stage(_encoded(documents, first, second), "encoded")  # in the order made: no task sorts its ids
    columns = [f.name for f in _ROW]
    none = F.lit(None).cast("binary")
    docs = rows.filter(f"kind = {DOCS}").withColumns({"keys": none, "counts": none}).select(*columns)
    blocks = docs.count()
    twigs = max(1, -(-blocks // TWIG))
    twig = F.pmod(F.xxhash64("block"), F.lit(twigs)).alias("twig")
    asks = rows.filter(f"kind = {ASK}").select(*columns, twig)
    functions = _hashed(asks, scratch)
    tables = _summed(asks, functions, twigs, scratch)
    return _looked_up(docs, _answers(asks, tables, twigs), first, second, whole)


def counts(documents: DataFrame, scratch: Scratch, first: str, second: str) -> DataFrame:
    """``(first_id, second_id, documents, best)``: every linked pair of the corpus."""
    rows = scratch.stage(_encoded(documents, first, second), "encoded")
    asks = rows.filter(f"kind = {ASK}").select(*[f.name for f in _ROW], F.lit(0).cast("long").alias("twig"))
    tables = _summed(asks, _hashed(asks, scratch), 1, scratch)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, marked = PerfectHash.from_bytes(row["keys"]).keys, _counts(row["counts"])
            columns = [(keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), marked >> 1]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array((marked & 1).astype(bool))],
                names=["first_id", "second_id", "documents", "best"],
            )

    return tables.mapInArrow(listed, "first_id long, second_id long, documents long, best boolean")
