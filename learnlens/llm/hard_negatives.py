"""Hard negatives by a secondary-sort shuffle.

The score of an anchor and another row is packed with their ids into one key of bytes: anchor, score from the
highest down, id, and whether both have one label.  ``repartitionAndSortWithinPartitions`` deals the keys by
anchor and sorts them in the shuffle, so a task streams each anchor's rows from the nearest to the
farthest.  A positive opens a window of scores; a negative whose score lies in an open window is given out; a
window closes when it has its negatives or its lowest score is passed.  What is held of an anchor are its few
windows.

All rows are scored against all anchors, tile by tile: a tile is a set of rows that a task holds as one
matrix, and anchors stream past it.  Of what a tile scores only what can be among the first leaves it:
first the tile's nearest rows of the anchor's label, which give the positives; then, inside the windows of
these, the tile's first different-label rows of each window.  Both cuts lose nothing: a row among the first
of all is among the first of its tile.

Components are scaled and rounded down to whole numbers, and scores are exact integers.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
part; of rows with one id, the smallest by label and vector counts; only rows of one dimension
are compared; equal scores go by the smaller id; a positive score of 0 asks for negatives of score 0, a
negative one for none; scores beyond 64 bits count as the ends of that range; an anchor without positives or
a positive without negatives gives no rows, and neither does an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.llm.shared import Scratch, width


@dataclass(frozen=True)
class Mining:
    """``low`` and ``high``: bounds of a negative's score in hundredths of the positive's; ``tile`` and
    ``components``: rows and numbers that a task holds at a time, about."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    tile: int = 1 << 16
    components: int = 1 << 23


_LOWEST, _HIGHEST = -(2**63), 2**63 - 1
_KEY = struct.Struct(">QQQ?")
_BIAS = 1 << 63
BATCH = 64  # anchors that pass a tile at a time


def packed_key(anchor: int, score: int, row: int, same: bool) -> bytes:
    """Keys sort by anchor, then falling score, then id."""
    return _KEY.pack(anchor + _BIAS, _HIGHEST - score, row + _BIAS, same)


def unpacked_key(key: bytes) -> tuple[int, int, int, bool]:
    anchor, score, row, same = _KEY.unpack(key)
    return anchor - _BIAS, _HIGHEST - score, row - _BIAS, same


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Components times ``scale``, rounded down: floats that hold integers exactly."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(vectors.astype(np.float64) * scale, -np.finfo(float).max, np.finfo(float).max))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, in 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        bound = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**62 and max(np.abs(a).max(), np.abs(b).max()) < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    exact = [[sum(map(int.__mul__, x, y)) for y in whole[1]] for x in whole[0]]
    return np.array([[min(max(s, _LOWEST), _HIGHEST) for s in row] for row in exact], np.int64)


def window_of(score: int, mining: Mining) -> tuple[int, int]:
    """Lowest and highest score of the negatives of a positive."""
    return -(-mining.low * score // 100), mining.high * score // 100


def first_places(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, number: int) -> np.ndarray:
    """Of ``places`` the first ``number``: the highest scores, ties by the smaller id."""
    if len(places) > 4 * number:
        own = scores[places]
        places = places[own >= np.partition(own, len(own) - number)[len(own) - number]]
    order = np.lexsort((ids[places], ~scores[places]))  # ~ turns the order round, at the lowest number too
    return places[order[:number]]


class _Tile:
    """The rows of a tile, by dimension."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.parts = {}
        for size in {len(v) for _, _, v in rows}:
            own = [r for r in rows if len(r[2]) == size]
            ids, labels = (np.array([r[i] for r in own], np.int64) for i in (0, 1))
            self.parts[size] = ids, labels, np.stack([r[2] for r in own])

    def scored(self, anchors: list[tuple]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
        """Every anchor with the ids, labels and scores of the rows it is compared with."""
        for size, (ids, labels, matrix) in self.parts.items():
            own = [a for a in anchors if len(a[2]) == size]
            for at in range(0, len(own), BATCH):
                part = own[at : at + BATCH]
                table = products(np.stack([a[2] for a in part]), matrix)
                for anchor, scores in zip(part, table, strict=True):
                    yield anchor, ids, labels, scores


_SENT = "tile int, kind int, id long, label long, vector array<double>, windows array<long>"


def _rows(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
    for batch in batches:
        column = batch.column("vector")
        flat = whole_numbers(column.flatten().to_numpy(zero_copy_only=False), scale)
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        others = (batch.column(c).to_pylist() for c in ("tile", "kind", "id", "label", "windows"))
        for tile, kind, name, label, windows, a, b in zip(*others, offsets[:-1], offsets[1:], strict=True):
            yield tile, kind, name, label, flat[a:b], windows


def _keys(rows: DataFrame, anchors: DataFrame, tiles: int, mining: Mining, choose) -> DataFrame:
    """``(key)``: what ``choose`` keeps of each tile and anchor, packed.

    Anchors go to all tiles.  Rows come first in a tile, anchors then stream past.
    """
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    no_windows = F.lit(None).cast("array<long>")
    dealt = rows.select(tile.alias("tile"), F.lit(0).alias("kind"), "id", "label", "vector", no_windows.alias("windows"))
    windows = F.col("windows") if "windows" in anchors.columns else no_windows
    sent = anchors.select(every.alias("tile"), F.lit(1).alias("kind"), "id", "label", "vector", windows.alias("windows"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked, tile, now = [], [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            keys = [
                packed_key(anchor[0], int(scores[i]), int(ids[i]), bool(labels[i] == anchor[1]))
                for anchor, ids, labels, scores in tile.scored(asked)
                for i in choose(anchor, ids, labels, scores)
            ]
            asked.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

        for number, kind, name, label, vector, spans in _rows(batches, mining.scale):
            if number != now:
                if asked:
                    yield from flush()
                held, tile, now = [], None, number
            if kind == 0:
                held.append((name, label, vector))
                continue
            if tile is None:
                tile, held = _Tile(held), []
            asked.append((name, label, vector, spans))
            if len(asked) == BATCH:
                yield from flush()
        if asked:
            yield from flush()

    return (
        dealt.unionByName(sent)
        .repartition("tile")
        .sortWithinPartitions("tile", "kind", "id")
        .mapInArrow(score, "key binary")
    )


def _streamed(keys: DataFrame, parts: int, work, ddl: str) -> DataFrame:
    """``work`` over the unpacked keys of each anchor in their order, one after another."""

    def unpacked(pairs: Iterable[tuple[bytes, None]]) -> Iterator[tuple]:
        for key, _ in pairs:
            yield unpacked_key(key)

    sorted_keys = (
        keys.rdd.map(lambda row: (bytes(row[0]), None))
        .repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    )
    return keys.sparkSession.createDataFrame(
        sorted_keys.mapPartitions(lambda pairs: work(unpacked(pairs))), ddl, verifySchema=False
    )


def opened_windows(rows: Iterable[tuple[int, int, int, bool]], mining: Mining) -> Iterator[tuple]:
    """Negatives ``(anchor, positive, rank, negative, positive score, negative score)`` from the rows of
    anchors in order; an anchor's positives are its first rows of the same label."""
    anchor, positives, windows, zeros = None, 0, [], []
    for name, score, row, same in rows:
        if name != anchor:
            anchor, positives, windows, zeros = name, 0, [], []
        if same:
            if positives == mining.positives:
                continue
            positives += 1
            low, high = window_of(score, mining)
            if low <= high:
                window = [row, score, low, high, 0]
                windows.append(window)
                # a negative of equal score may come before its positive: at 0 alone is it in the window
                for negative in zeros if score == 0 else ():
                    window[4] += 1
                    yield anchor, row, window[4], negative, score, 0
            continue
        if score == 0 and len(zeros) < mining.negatives:
            zeros.append(row)
        for window in windows:
            if window[2] <= score <= window[3] and window[4] < mining.negatives:
                window[4] += 1
                yield anchor, window[0], window[4], row, window[1], score
        windows = [w for w in windows if w[4] < mining.negatives and score >= w[2]]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def mine(
    embeddings: DataFrame,
    scratch: Scratch,
    is_anchor: Column,
    label: Column | None = None,
    mining: Mining | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``embeddings`` has ``vec_id``, ``embedding`` and ``label``; ``label`` may say it otherwise.
    """
    mining = mining or Mining()
    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    label = F.col("label") if label is None else label
    rows = (
        embeddings.select(
            F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        )
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
        .groupBy("id")
        .agg(F.min(F.struct("label", "vector", "asks")).alias("row"))
        .select("id", "row.*")
    )
    rows = scratch.stage(rows, "rows")
    anchors = rows.filter("asks")
    parts = width(spark)
    held = rows.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("size")).first()
    tiles = max(parts, -(-held["n"] // mining.tile), -(-(held["size"] or 0) // mining.components))

    def nearest_alike(anchor, ids, labels, scores):
        return first_places(scores, ids, np.flatnonzero((labels == anchor[1]) & (ids != anchor[0])), mining.positives)

    def first(found: Iterator[tuple]) -> Iterator[tuple]:
        now, number = None, 0
        for anchor, score, row, _ in found:
            now, number = anchor, number + 1 if anchor == now else 1
            if number <= mining.positives:
                yield anchor, row, score

    alike = _keys(rows, anchors, tiles, mining, nearest_alike)
    positives = scratch.stage(_streamed(alike, parts, first, "anchor long, id long, score long"), "positives")

    def inside(anchor, ids, labels, scores):
        other = labels != anchor[1]
        chosen: set[int] = set()
        for score in set(anchor[3]):
            low, high = window_of(score, mining)
            there = np.flatnonzero(other & (scores >= low) & (scores <= high))
            chosen.update(first_places(scores, ids, there, mining.negatives).tolist())
        return chosen

    asking = positives.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("windows"))
    negatives = _keys(rows, anchors.join(asking, "id"), tiles, mining, inside)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "score", "id"))
            keys = [packed_key(*row, True) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    both = negatives.unionByName(positives.mapInArrow(key, "key binary"))
    return _streamed(
        both,
        parts,
        lambda found: opened_windows(found, mining),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )
