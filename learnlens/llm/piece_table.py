"""SentencePiece ids through a table of distinct chunks.

A chunk is a run of white-space markers with what follows up to the next marker.  Where no piece
of the model crosses from another character to a marker, and none of the model's steps looks across,
a text's pieces are the pieces of its chunks in a row.  Every distinct chunk is segmented once
by the library, in the shard that its hash names; texts are kept as local chunk numbers by
block, and the ids are joined back by position.

``check_model`` refuses models for which this does not hold.

Defined results: a null text is an empty one, whose only id is the end id; rows keep their doc_id
whatever it is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from learnlens.llm import blocks
from learnlens.llm.shared import Scratch, cut, packed, rows_of, unpacked, width

_MARKER = "▁".encode()
_RUNS = re.compile(rb" +[^ ]*")


def chunks(text: str) -> list[bytes]:
    """Chunks without their first marker; other markers are spaces."""
    data = text.encode()
    if not data:
        return []
    if _MARKER in data:
        data = data.replace(_MARKER, b" ")
    if b"  " in data or data[:1] == b" ":
        return [run[1:] for run in _RUNS.findall(b" " + data)]
    return data.split(b" ")


def check_model(path: str) -> None:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as source:
        model.ParseFromString(source.read())
    spec = model.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces
    crossing = any(re.search("[^▁]▁", p.piece) or p.type == p.USER_DEFINED for p in model.pieces)
    if crossing or not plain or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the pieces of this model may depend on more than one chunk")


BLOCK_BYTES = 16 << 20  # smaller ones are more even, and ask for more words in all

_MODELS: dict = {}


def _model(path: str):
    if path not in _MODELS:
        from sentencepiece import SentencePieceProcessor

        _MODELS[path] = SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def encode(documents: DataFrame, scratch: Scratch, model: str) -> DataFrame:
    """``(doc_id, ids)`` as parcels' rows would hold them: see ``digests`` for what is asked."""
    return _joined(documents, scratch, model, lambda doc_id, ids, _: (doc_id, ids.tolist()), [
        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))
    ], "doc_id long, ids array<int>")


def digests(documents: DataFrame, scratch: Scratch, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""

    def row(doc_id, ids, written):
        text = _model(model).decode(ids.tolist())
        return (
            doc_id,
            len(ids),
            hashlib.sha256(written.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )

    return _joined(documents, scratch, model, row, [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())
    ], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _joined(documents: DataFrame, scratch: Scratch, path: str, row, fields, ddl: str) -> DataFrame:
    check_model(path)
    shards = width(documents.sparkSession)
    # coded texts are the bulk: they are written once, in buckets by block, and stay where they are
    parcels = scratch.bucketed(blocks.coded(documents, chunks, shards, block_bytes=BLOCK_BYTES), "blocks", "block", shards, by=["kind"])
    asked = parcels.filter(f"kind = {blocks.KEYS}").select(*_columns(parcels))

    def segment(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        processor = _model(path)
        lone = [processor.piece_to_id("▁")]  # a marker without text
        known: dict[bytes, list[int]] = {}
        for ask in own:
            keys = cut(ask["keys"], unpacked(ask["lens"]))
            fresh = [k for k in keys if k not in known]
            if len(known) + len(fresh) > 1_000_000:  # memory is bounded; ids do not depend on it
                known, fresh = {}, keys
            texts = [k.decode() for k in fresh]
            for key, ids in zip(fresh, processor.encode(texts, num_threads=1), strict=True):
                known[key] = ids if key else lone
            found = [known[k] for k in keys]
            sizes = np.fromiter(map(len, found), np.uint32, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
            yield blocks.batch_of(
                [
                    blocks.parcel(
                        blocks.KEYS, ask["block"], ask["shard"],
                        codes=bytes(ask["codes"]), lens=packed(sizes), nums=packed(flat),
                    )
                ]
            )

    answers = blocks.by(asked, "shard", segment).select("block", "codes", "lens", "nums")
    docs = parcels.filter(f"kind = {blocks.DOCS}").select("block", "ids", "lens", "codes")

    def join(coded: pa.Table, answered: pa.Table) -> pa.Table:
        """The documents of one block, and the ids of its chunks."""
        end = _model(path).eos_id()
        places, sizes, ids = [], [], []
        for got in rows_of(answered.to_batches()):
            places.append(blocks.places_of(got))
            sizes.append(unpacked(got["lens"]))
            ids.append(unpacked(got["nums"]))
        flat, starts, size, written = _by_place(places, sizes, ids)
        batches = [_batch([], fields)]
        for got in rows_of(coded.to_batches()):
            codes = unpacked(got["codes"])
            out, at = [], 0
            for doc_id, count in zip(got["ids"], unpacked(got["lens"]).tolist(), strict=True):
                code = codes[at : at + count]
                at += count
                own_size = size[code]
                stops = np.cumsum(own_size)
                total = int(stops[-1]) if count else 0
                place = np.arange(total) + np.repeat(starts[code] - (stops - own_size), own_size)
                doc = np.append(flat[place], np.uint32(end))
                text = " ".join([*map(written.__getitem__, code.tolist()), str(end)])
                out.append(row(doc_id, doc, text))
                if len(out) == 1000:
                    batches.append(_batch(out, fields))
                    out = []
            batches.append(_batch(out, fields))
        return pa.Table.from_batches(batches)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, ddl)


def _by_place(places, sizes, ids):
    """Ids, starts, sizes and the ids in writing of each local chunk number."""
    if not places:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), []
    place = np.concatenate(places)
    size = np.empty(len(place), np.int64)
    size[place] = all_sizes = np.concatenate(sizes).astype(np.int64)
    starts = np.empty(len(place), np.int64)
    starts[place] = np.cumsum(all_sizes) - all_sizes
    flat = np.concatenate(ids)
    names = list(map(str, range(int(flat.max(initial=0)) + 1)))
    words = list(map(names.__getitem__, flat.tolist()))
    written = [" ".join(words[a:b]) for a, b in zip(starts.tolist(), (starts + size).tolist(), strict=True)]
    return flat, starts, size, written


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )


def _columns(parcels: DataFrame) -> list[str]:
    return [c.split()[0] for c in blocks.PARCEL.split(", ")]
