"""Token-id files coded with a static range asymmetric numeral system.

One table of token frequencies is counted over the whole corpus, scaled to ``2**BITS`` and shared
by all files.  A file holds spans, a span whole documents in order, coded as blocks of at most
``BLOCK`` tokens.  A block is coded by itself: its lanes are states that take every lanes-th
token in turn, so numpy codes one token of each lane at a time.  The footer lists where each
block starts in bytes and in tokens (the checkpoints) and which documents a span holds, so any
span can be decoded alone; every block has a checksum of its decoded ids, and the footer one of
the table it needs.

Layout, little endian: ``magic``, blocks, footer, footer length (u64), footer crc32 (u32), ``magic``.
A block: tokens, lanes, words, crc32 (u32 each), lane states (u64), words (u32).

Files are named at random and count only once the table of written spans is committed, so what
a lost task has left is never read.  Documents come in ascending doc_id order within and across
files; rows with a null doc_id come first, in ranges of their texts' hashes, rows with equal doc_ids in the
order of their ids' bytes.  A table has at most ``2**BITS`` distinct tokens.  A
null or empty text is the end id alone; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.shared import Scratch, even_keys, expanded, packed, squeezed, text_rows, unpacked, width
from learnlens.llm.tokens import hugging_table

MAGIC = b"RANS0001"
BITS = 20
BLOCK = 1 << 19
SPAN = 1 << 20
FILE = 1 << 24  # tokens in a file, about
LANES = 2048
COUNTS = -1
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Frequencies:
    """The shared table: ``counts`` scaled to a sum of ``2**BITS``, at least one for each token
    that occurs."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        size = 1 << BITS
        if np.count_nonzero(counts) > size:
            raise ValueError(f"more than {size} distinct tokens")
        scaled = np.where(counts > 0, np.maximum(counts * size // max(1, int(counts.sum())), 1), 0)
        if counts.any():
            spare = size - int(scaled.sum())
            order = np.argsort(-counts, kind="stable")
            if spare >= 0:
                scaled[order[0]] += spare
            while spare < 0:  # what rare ones got too much is taken from the common ones
                for token in order[: int((scaled > 1).sum())]:
                    taken = min(-spare, int(scaled[token]) // 2)
                    scaled[token] -= taken
                    spare += taken
        self.frequency = scaled.astype(np.uint64)
        ends = np.cumsum(scaled)
        self.start = (ends - scaled).astype(np.uint64)
        self.crc = zlib.crc32(scaled.astype("<u4").tobytes())
        self._tokens: np.ndarray | None = None

    def to_bytes(self) -> bytes:
        return self.frequency.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Frequencies:
        made = cls.__new__(cls)
        scaled = np.frombuffer(raw, "<u4").astype(np.int64)
        made.frequency = scaled.astype(np.uint64)
        made.start = (np.cumsum(scaled) - scaled).astype(np.uint64)
        made.crc = zlib.crc32(raw)
        made._tokens = None
        return made

    @property
    def tokens(self) -> np.ndarray:
        """The token of each of the ``2**BITS`` slots."""
        if self._tokens is None:
            count = len(self.frequency)
            kind = np.uint16 if count <= 1 << 16 else np.uint32
            self._tokens = np.repeat(np.arange(count, dtype=kind), self.frequency.astype(np.int64))
        return self._tokens


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 256)))
    state = np.full(lanes, _LOW, np.uint64)
    limit = np.uint64(63 - BITS)
    frequency, start = table.frequency[ids], table.start[ids]
    words: list[np.ndarray] = []
    for row in range(-(-n // lanes) - 1, -1, -1):
        f, c = frequency[row * lanes : (row + 1) * lanes], start[row * lanes : (row + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << limit
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        whole = x // f
        state[: len(f)] = (whole << np.uint64(BITS)) + (x - whole * f) + c
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    head = np.array([n, lanes, len(stream), zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
    return head.tobytes() + state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()


def decode_block(raw: memoryview, table: Frequencies) -> np.ndarray:
    n, lanes, count, crc = np.frombuffer(raw, "<u4", 4).tolist()
    state = np.frombuffer(raw, "<u8", lanes, 16).astype(np.uint64)
    stream = np.frombuffer(raw, "<u4", count, 16 + 8 * lanes).astype(np.uint64)
    ids = np.empty(n, np.uint32)
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    at = 0
    for row in range(0, n, lanes):
        out = ids[row : row + lanes]
        x = state[: len(out)]
        slot = x & mask
        token = table.tokens[slot]
        out[:] = token
        x = table.frequency[token] * (x >> bits) + slot - table.start[token]
        low = np.flatnonzero(x < _LOW)
        x[low] = x[low] << _WORD | stream[at : at + len(low)]
        at += len(low)
        state[: len(out)] = x
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids does not match its checksum")
    return ids


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that all executors share."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class _FileWriter:
    """One file: spans of whole documents."""

    def __init__(self, folder: str, table: Frequencies):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.rans"
        self.out = system.open_output_stream(f"{path}/{self.name}")
        self.out.write(MAGIC)
        self.at, self.tokens, self.table = len(MAGIC), 0, table
        self.spans: list[dict] = []
        self._clear()

    def _clear(self) -> None:
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: list[int] = []
        self.held: list[np.ndarray] = []
        self.held_tokens, self.span_tokens, self.span_at = 0, 0, self.at

    def _block(self, ids: np.ndarray) -> None:
        raw = encode_block(ids, self.table)
        self.out.write(raw)
        self.blocks.append(len(raw))
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.span_tokens += len(ids)
        self.held.append(ids)
        self.held_tokens += len(ids)
        if self.held_tokens >= BLOCK:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % BLOCK
            for begin in range(0, cut, BLOCK):
                self._block(whole[begin : begin + BLOCK])
            self.held, self.held_tokens = [whole[cut:]], len(whole) - cut
        if self.span_tokens >= SPAN:
            self.end_span()

    def end_span(self) -> None:
        if not self.docs:
            return
        if self.held_tokens:
            self._block(np.concatenate(self.held))
        ids, sizes = zip(*self.docs, strict=True)
        self.spans.append(
            {"at": self.span_at, "token": self.tokens, "blocks": self.blocks, "docs": ids, "sizes": sizes}
        )
        self.tokens += self.span_tokens
        self._clear()

    def close(self) -> None:
        self.end_span()
        footer = squeezed(
            json.dumps({"table": self.table.crc, "spans": self.spans}).encode()
        )
        tail = np.array([len(footer)], "<u8").tobytes() + np.array([zlib.crc32(footer)], "<u4").tobytes()
        self.out.write(footer + tail + MAGIC)
        self.out.close()


_TAIL = 8 + 4 + len(MAGIC)


def read_footer(folder: str, name: str) -> dict:
    system, path = _open(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        size = source.size()
        tail = source.read_at(_TAIL, size - _TAIL)
        length = int(np.frombuffer(tail, "<u8", 1)[0])
        footer = source.read_at(length, size - _TAIL - length)
        if tail[12:] != MAGIC or zlib.crc32(footer) != np.frombuffer(tail, "<u4", 1, 8)[0]:
            raise ValueError(f"{name} is not a whole file of token ids")
    return json.loads(expanded(footer))


def read_span(folder: str, name: str, span: dict, table: Frequencies) -> Iterator[np.ndarray]:
    """The ids of each document of a span."""
    system, path = _open(folder)
    ids = []
    with system.open_input_file(f"{path}/{name}") as source:
        raw = memoryview(source.read_at(sum(span["blocks"]), span["at"]))
    at = 0
    for size in span["blocks"]:
        ids.append(decode_block(raw[at : at + size], table))
        at += size
    whole = np.concatenate(ids)
    yield from np.split(whole, np.cumsum(span["sizes"])[:-1])


def _sorted_ids(documents: DataFrame, scratch: Scratch, encode: Callable, end_id: int) -> DataFrame:
    """``(part, doc_id, ids)`` written in ascending doc_id order within parts; as part COUNTS, how
    often each token occurs in what a task has read."""
    parts = width(documents.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    edges = documents.select(F.percentile_approx("doc_id", shares, 10_000).alias("e")).first()["e"]
    edges = np.unique(np.array(edges or [], np.int64))
    keys = np.array(even_keys(documents.sparkSession, parts), np.int64)  # a part is a task's own

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encode()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                doc_ids, texts, marks = (part.column(c).to_pylist() for c in ("doc_id", "text", "mark"))
                where = [
                    (m + (1 << 63)) * parts >> 64 if d is None else parts + int(np.searchsorted(edges, d, "right"))
                    for d, m in zip(doc_ids, marks, strict=True)
                ]
                coded = [np.append(ids, np.uint32(end_id)) for ids in ids_of(texts)]
                total = _added(total, np.bincount(np.concatenate(coded)))
                blobs = [packed(ids) for ids in coded]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[np.array(where) % parts]), pa.array(where, pa.int32()),
                        pa.array(doc_ids, pa.int64()), pa.array(blobs, pa.binary()),
                    ],
                    names=["dealt", "part", "doc_id", "ids"],
                )
        if len(total):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0], pa.int64()), pa.array([COUNTS], pa.int32()), pa.array([None], pa.int64()),
                    pa.array([packed(total)]),
                ],
                names=["dealt", "part", "doc_id", "ids"],
            )

    marked = documents.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    coded = marked.mapInArrow(tokenized, "dealt long, part int, doc_id long, ids binary")
    ordered = coded.repartition(parts, "dealt").sortWithinPartitions("part", "doc_id", "ids")
    return scratch.stage(ordered.drop("dealt"), "ids")


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    if len(more) > len(total):
        total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
    total[: len(more)] += more
    return total


def _counts(coded: DataFrame) -> np.ndarray:
    """How often each token occurs: as many numbers as the vocabulary has, on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for (blob,) in text_rows(batches, "ids"):
            total = _added(total, unpacked(blob).astype(np.int64))
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(total[token])], names=["token", "n"])

    rows = coded.filter(f"part = {COUNTS}").select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((row["token"] for row in rows), default=0), np.int64)
    for row in rows:
        counts[row["token"]] = row["n"]
    return counts


def write_ids(documents: DataFrame, scratch: Scratch, tokenizer: str, kind: str, end_id: int = 2) -> DataFrame:
    """Write the files; ``(folder, name, part, first, seq, tokens)``, one row per file."""

    def encode():
        return hugging_table(tokenizer, kind).ids

    coded = _sorted_ids(documents, scratch, encode, end_id)
    table = Frequencies(_counts(coded))
    folder = scratch.fresh("files")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/frequencies") as out:
        out.write(table.to_bytes())
    shared = documents.sparkSession.sparkContext.broadcast(table.to_bytes())  # vocabulary size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies.from_bytes(shared.value)
        writer, done, last = None, [], None

        def close():
            writer.close()
            done.append((folder, writer.name, last[0], writer.spans[0]["docs"][0], last[1], writer.tokens))

        for part, doc_id, blob in text_rows(batches, "part", "doc_id", "ids"):
            key = (part, -(2**63) if doc_id is None else doc_id)
            # a task may read pieces of several sorted files: each gets files of its own
            if writer and (part != last[0] or key < last or writer.tokens >= FILE):
                close()
                writer = None
            writer = writer or _FileWriter(folder, table)
            writer.add(doc_id, unpacked(blob))
            last = key
        if writer:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["folder", "name", "part", "first", "last", "tokens"],
        )

    ddl = "folder string, name string, part int, first long, last long, tokens long"
    files = scratch.stage(coded.filter(f"part <> {COUNTS}").mapInArrow(write, ddl), "manifest")
    scratch.drop("ids")
    return files


def read_ids(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` decoded from the files of a manifest."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    in_part = Window.partitionBy("part").orderBy(
        F.col("first").asc_nulls_first(), "last", "name"
    ).rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(bases, "part").withColumn(
        "base", F.col("base") + F.coalesce(F.sum("tokens").over(in_part), F.lit(0))
    )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder, name, base in text_rows(batches, "folder", "name", "base"):
            whole = read_footer(folder, name)
            plan = [json.dumps({"table": whole["table"], "span": span}) for span in whole["spans"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(plan), k) for c, k in ((folder, pa.string()), (name, pa.string()), (base, pa.int64()))]
                + [pa.array(plan)],
                names=["folder", "name", "base", "plan"],
            )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Frequencies] = {}
        for folder, name, base, plan in text_rows(batches, "folder", "name", "base", "plan"):
            if folder not in tables:
                system, path = _open(folder)
                with system.open_input_stream(f"{path}/frequencies") as source:
                    tables[folder] = Frequencies.from_bytes(source.read())
            plan = json.loads(plan)
            if plan["table"] != tables[folder].crc:
                raise ValueError(f"{name} was written with another table of frequencies")
            span = plan["span"]
            crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in read_span(folder, name, span, tables[folder])]
            sizes = np.array(span["sizes"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(span["docs"], pa.int64()),
                    pa.array(base + span["token"] + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    planned = placed.select("folder", "name", "base").mapInArrow(
        spans, "folder string, name string, base long, plan string"
    )
    spread = planned.repartition(width(files.sparkSession))
    return spread.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
