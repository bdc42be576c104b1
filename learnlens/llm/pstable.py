"""Nearest neighbours by cosine with multiprobe p-stable hashing.

Vectors are scaled to unit length, where the order by cosine is the order by distance.  Each of
``tables`` tables cuts space by ``hashes`` random directions (normal, hence 2-stable) into cells of width
``cell``.  Every vector is filed in its cell of each table.  A query looks into its own cell and into
the neighbouring cells that most likely hold its neighbours: steps over a boundary are sorted by the
squared distance to it, and sets of steps come from a heap in the order of their summed distances.
The candidates of all tables are merged and ranked by their exact cosine.  A query that finds fewer than
``k`` this way is compared with all entries of its dimension.

Equal vectors are one entry with the ``k + 1`` smallest ids, more of which no list can hold.  Cells
with more than ``tile`` entries are cut into tiles, and queries are sent to each, so the
work of a task is bounded and every entry is compared.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
neither as query nor as candidate; only vectors of one dimension are compared; a row with a null id
takes no part; rows with equal id and vector are one row, and a query never finds its own id;
equal scores go by the smaller id; rows with one id and different vectors are entries of their own, as
queries they share one list, of the best over their vectors; a query gets fewer than ``k`` rows only where there
are no more candidates; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.shared import Scratch


@dataclass(frozen=True)
class Index:
    """Parameters: fitted to no data, so every row is indexed the same way."""

    tables: int = 10
    hashes: int = 4
    cell: float = 1.0
    probes: int = 50
    tile: int = 4096
    seed: int = 7


def directions(index: Index, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of all tables, a function of the parameters alone."""
    random = np.random.default_rng([index.seed, dimension])
    width = index.tables * index.hashes
    return random.standard_normal((dimension, width)), random.random(width) * index.cell


def _cells(cells: np.ndarray) -> np.ndarray:
    """Cell coordinates, a row each, as one 64-bit number."""
    key = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64)
    for column in cells.astype(np.int64).astype(np.uint64).T:
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def perturbations(position: np.ndarray, number: int) -> np.ndarray:
    """Steps to the ``number`` likeliest cells for a query at ``position`` (0 to 1) in its own."""
    size = len(position)
    cost = np.concatenate([position**2, (1 - position) ** 2])
    step = np.repeat([-1, 1], size)
    axis = np.tile(np.arange(size), 2)
    order = np.argsort(cost, kind="stable")
    cost, step, axis = cost[order].tolist(), step[order], axis[order]
    found = [np.zeros(size, np.int64)]
    heap = [(cost[0], (0,))]
    while heap and len(found) < number:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * size:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        axes = axis[list(chosen)]
        if len(set(axes.tolist())) == len(axes):  # not over both boundaries of one axis
            steps = np.zeros(size, np.int64)
            steps[axes] = step[list(chosen)]
            found.append(steps)
    return np.stack(found)


PAIRS = 1 << 15  # scored at once

_FILED = "cell_table int, cell long, kind int, id long, ids array<bigint>, vector binary"
_NAMES = [c.split()[0] for c in _FILED.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors, one dimension after another."""
    column = batch.column("vector")
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)].astype(np.float64)


EVERYWHERE = -1  # the table of which the only cell of a dimension holds all entries


def _filed(rows: DataFrame, index: Index, kind: int, everywhere: bool = False) -> DataFrame:
    """Entries (kind 0) under their cells, or queries (kind 1) under the cells they probe.

    ``everywhere``: both under one cell, their dimension.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                ids = batch.column("id").to_pylist()
                lists = batch.column("ids").to_pylist()
                for places, vectors in _vectors(batch):
                    along, shift = directions(index, vectors.shape[1])
                    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                    at_cells = (unit @ along + shift) / index.cell
                    cells = np.floor(at_cells)
                    blobs = [v.tobytes() for v in vectors]
                    for table in [EVERYWHERE] if everywhere else range(index.tables):
                        own = slice(table * index.hashes, (table + 1) * index.hashes)
                        if everywhere:
                            rows_, keys = np.arange(len(places)), np.full(len(places), vectors.shape[1])
                        elif kind == 0:
                            rows_, keys = np.arange(len(places)), _cells(cells[:, own])
                        else:
                            probes = [
                                cells[i, own] + perturbations(at_cells[i, own] - cells[i, own], index.probes)
                                for i in range(len(places))
                            ]
                            rows_ = np.repeat(np.arange(len(places)), [len(p) for p in probes])
                            keys = _cells(np.concatenate(probes))
                        columns = [
                            np.full(len(keys), table), keys, np.full(len(keys), kind),
                            [ids[places[i]] for i in rows_], [lists[places[i]] for i in rows_],
                            [blobs[i] for i in rows_],
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES
                        )

    return rows.select("id", "ids", "vector").mapInArrow(file, _FILED)


class _Best:
    """The best entries of each query so far; trimmed when they pass a bound."""

    def __init__(self, k: int, bound: int = 500_000):
        self.k, self.bound, self.size = k, bound, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, query, score, node, place) -> None:
        self.parts.append((query, score, node, place))
        self.size += len(query)
        if self.size > self.bound:
            self.trim()

    def trim(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64, object))
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        query, score, node, _ = columns
        order = np.lexsort((node, -score, query))
        query, node = query[order], node[order]
        fresh = np.ones(len(order), bool)  # tables find the same entry again: equal score and node
        fresh[1:] = (query[1:] != query[:-1]) | (node[1:] != node[:-1])
        order, query = order[fresh], query[fresh]
        first = np.searchsorted(query, query)
        order = order[np.arange(len(query)) - first < self.k + 1]
        self.parts = [tuple(c[order] for c in columns)]
        self.size = len(order)
        self.bound = max(self.bound, 2 * self.size)
        return self.parts[0]


def _ranked(filed: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query_id, node, ids, score)``: the best of each query among the entries of a task."""
    key = ["cell_table", "cell", "tile"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, entries, now = _Best(k), [], None
        matrix = norms = nodes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*key, "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(values, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
            vectors = batch.column("vector").to_pylist()
            ids, lists = batch.column("id").to_numpy(), batch.column("ids").to_pylist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group = tuple(values[:3, a].tolist())
                if group != now:
                    now, entries, matrix = group, [], None
                if values[3, a] == 0:
                    entries += [(ids[i], lists[i], vectors[i]) for i in range(a, b)]
                    continue
                if not entries:
                    continue
                for size in {len(v) for v in vectors[a:b]}:
                    own = [e for e in entries if len(e[2]) == size]
                    rows = [i for i in range(a, b) if len(vectors[i]) == size]
                    if not own:
                        continue
                    matrix = np.frombuffer(b"".join(e[2] for e in own), np.float64).reshape(len(own), -1)
                    norms = np.linalg.norm(matrix, axis=1)
                    nodes = np.array([e[0] for e in own])
                    margin = 4 * (matrix.shape[1] + 4) * np.finfo(np.float64).eps  # of rough sums
                    places = np.empty(len(own), object)
                    places[:] = [e[1] for e in own]
                    queries = np.frombuffer(b"".join(vectors[i] for i in rows), np.float64).reshape(len(rows), -1)
                    for at in range(0, len(rows), 512):
                        part = queries[at : at + 512]
                        rough = part @ matrix.T / norms
                        length = np.linalg.norm(part, axis=1)
                        # all that may tie with the last place: what is cut is left to score and id
                        last = max(len(own) - k - 1, 0)
                        bar = np.partition(rough, last, axis=1)[:, last] - margin * length
                        near, entry = np.nonzero(~(rough < bar[:, None]))
                        names = ids[rows[at : at + 512]]
                        for first in range(0, len(near), PAIRS):
                            x, y = near[first : first + PAIRS], entry[first : first + PAIRS]
                            # the exact cosine, summed in one order whatever the group
                            exact = (part[x] * matrix[y]).sum(1) / (length[x] * norms[y])
                            best.add(names[x], exact, nodes[y], places[y])
        query, score, node, place = best.trim()
        for at in range(0, len(query), 50_000):
            some = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(query[some]), pa.array(node[some]),
                    pa.array(place[some].tolist(), pa.list_(pa.int64())), pa.array(score[some]),
                ],
                names=["query_id", "node", "ids", "score"],
            )

    columns = [*key, "kind", "id", "ids", "vector"]
    return (
        filed.select(*columns)
        .repartition(*key)
        .sortWithinPartitions(*key, "kind", "id")
        .mapInArrow(rank, "query_id long, node long, ids array<bigint>, score double")
    )


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    embeddings: DataFrame, scratch: Scratch, is_query: Column, k: int = 5, index: Index | None = None
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every query."""
    index = index or Index()
    vector = F.col("embedding").cast("array<double>")
    rows = (
        embeddings.select(F.col("vec_id").alias("id"), vector.alias("vector"), is_query.alias("asks"))
        .filter(F.col("id").isNotNull() & usable(F.col("vector")))
        .distinct()
    )
    rows = scratch.stage(rows, "vectors")
    same = Window.partitionBy("vector").orderBy("id")
    entries = (
        rows.withColumn("place", F.row_number().over(same))
        .filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("id"), "ids", "vector")
    )
    entries = scratch.stage(entries, "entries")
    asked = rows.filter("asks").withColumn("ids", F.lit(None).cast("array<bigint>"))
    filed = scratch.stage(_filed(entries, index, 0), "filed")
    found = scratch.stage(_searched(filed, _filed(asked, index, 1), scratch, index, k), "found")

    # fewer than k in the cells looked into: all entries are candidates
    enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = scratch.stage(asked.join(enough, "id", "left_anti"), "short")
    if short.isEmpty():
        return found
    everywhere = _filed(entries, index, 0, True), _filed(short, index, 1, True)
    complete = _searched(*everywhere, scratch, index, k)
    others = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return others.select(*complete.columns).unionByName(complete)


def _searched(filed: DataFrame, probes: DataFrame, scratch: Scratch, index: Index, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of each query among the entries of its cells."""
    # cells too large for a task are cut; queries visit every tile
    crowded = (
        filed.groupBy("cell_table", "cell")
        .agg(F.ceil(F.count("*") / index.tile).cast("int").alias("tiles"))
        .filter("tiles > 1")
    )
    crowded = scratch.stage(crowded, "crowded")
    tiles = F.coalesce("tiles", F.lit(1))
    on = ["cell_table", "cell"]
    dealt = filed.join(crowded, on, "left").withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int"))
    sent = probes.join(crowded, on, "left").withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    both = dealt.drop("tiles").unionByName(sent.drop("tiles"))

    found = _ranked(both, index, k).groupBy("query_id", "node").agg(
        F.max("score").alias("score"), F.first("ids").alias("ids")
    )
    listed = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    best = listed.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
