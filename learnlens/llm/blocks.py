"""Dictionary-coded blocks of documents, and lookups of their words.

A block is a run of documents of some megabytes in which every distinct word (or chunk) has a local
number.  Looking a word up somewhere, in a table spread over the cluster, then costs one row entry
per block and distinct word and not one per occurrence: the words of a block are dealt to shards by
hash, a shard answers for its words, and the answers go back to the block.  However common a word is,
a block asks for it once.

All traffic has one row type, the parcel.  ``block`` and ``shard`` say where it goes, ``kind`` what
it is; the binary columns hold arrays.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from learnlens.llm.shared import packed, rows_of, squeezed, text_rows, unpacked

PARCEL = "block long, shard int, kind int, ids array<bigint>, lens binary, codes binary, keys binary, nums binary"
_FIELDS = pa.schema(
    [
        ("block", pa.int64()),
        ("shard", pa.int32()),
        ("kind", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("lens", pa.binary()),
        ("codes", pa.binary()),
        ("keys", pa.binary()),
        ("nums", pa.binary()),
    ]
)
DOCS, KEYS, TABLE = 9, 1, 0  # documents sort behind the answers to their block, tables first

BLOCK_BYTES = 32 << 20


def parcel(kind: int, block: int | None = None, shard: int | None = None, **columns) -> dict:
    return {"block": block, "shard": shard, "kind": kind, **columns}


def batch_of(parcels: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p.get(f.name) for p in parcels], f.type) for f in _FIELDS], schema=_FIELDS
    )


def sharded(keys: list[bytes], shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places in ``keys`` that each shard answers for."""
    shard = np.fromiter((zlib.crc32(k) % shards for k in keys), np.int32, len(keys))
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(shard[places[0]]), places


def key_columns(keys: list[bytes], places: np.ndarray) -> dict:
    own = [keys[i] for i in places.tolist()]
    return {
        "keys": squeezed(b"".join(own)),
        "lens": packed(np.fromiter(map(len, own), np.uint32, len(own))),
        "codes": packed(np.diff(places, prepend=0)),  # places ascend
    }


def places_of(row: dict) -> np.ndarray:
    """The local numbers that a KEYS parcel is about."""
    return np.cumsum(unpacked(row["codes"]), dtype=np.int64)


class Block:
    """Documents and the local numbers of their words."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, words: list[bytes], size: int) -> None:
        number = self.numbers.__getitem__
        self.codes.append(np.fromiter(map(number, words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.bytes += size + 64

    def rank(self) -> list[bytes]:
        """Number the words anew, the commonest first; the words in that order."""
        count = len(self.numbers)
        times = np.bincount(np.concatenate(self.codes), minlength=count)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(count, np.uint32)
        rank[order] = np.arange(count, dtype=np.uint32)
        self.codes = [rank[codes] for codes in self.codes]
        words = list(self.numbers)
        return [words[i] for i in order.tolist()]

    def docs(self, block: int) -> dict:
        codes = np.concatenate(self.codes)
        sizes = np.fromiter(map(len, self.codes), np.uint32, len(self.codes))
        return parcel(DOCS, block, ids=self.ids, lens=packed(sizes), codes=packed(codes))


def coded(
    documents: DataFrame,
    split: Callable[[str], list[bytes]],
    shards: int,
    extra: Callable[[Block, list[bytes]], Callable[[np.ndarray], dict]] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The parcels of all documents: DOCS for each block, KEYS for each block and shard.

    ``extra`` may add columns to the KEYS of a block.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # unique among the rows written; read back they stay the same
        number = TaskContext.get().partitionId() << 32
        block = Block()

        def finished() -> Iterator[pa.RecordBatch]:
            keys = block.rank()
            yield batch_of([block.docs(number)])
            more = extra(block, keys) if extra else lambda places: {}
            for shard, places in sharded(keys, shards):
                row = parcel(KEYS, number, shard, **key_columns(keys, places)) | more(places)
                yield batch_of([row])

        for doc_id, text in text_rows(batches, "doc_id", "text"):
            text = text or ""
            block.add(doc_id, split(text), len(text))
            if block.bytes >= block_bytes:
                yield from finished()
                number, block = number + 1, Block()
        if block.ids:
            yield from finished()

    return documents.select("doc_id", "text").mapInArrow(code, PARCEL)


def by(parcels: DataFrame, key: str, work: Callable[[Iterator[dict]], Iterator], schema: str = PARCEL) -> DataFrame:
    """``work`` over the parcels of one ``key`` at a time, in order of kind.

    ``work`` gets an iterator and holds what it wants of it; it yields record batches.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches)
        row = next(rows, None)
        while row is not None:
            current, ahead = row[key], [row]

            def own():
                while ahead[0] is not None and ahead[0][key] == current:
                    yield ahead[0]
                    ahead[0] = next(rows, None)

            mine = own()
            yield from work(mine)
            for _ in mine:  # what was left unread
                pass
            row = ahead[0]

    return parcels.repartition(key).sortWithinPartitions(key, "kind").mapInArrow(groups, schema)
