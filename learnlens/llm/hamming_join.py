"""Near duplicates by a multi-index Hamming join of MinHash signatures.

A text's set of word shingles gives a signature of ``symbols`` MinHash values cut to 16 bits.  Of two sets
with similarity J a symbol agrees with probability J, so sets at the wanted similarity differ in at
most ``distance`` symbols but for a chance that ``missed`` states (about one in fifty thousand
at exactly 0.8 with the default values, and far less above).

Pairs within ``distance`` are found without fail: the signature is split into ``chunks``; by the
pigeonhole two such signatures have a chunk with at most ``distance // chunks`` errors.  The errors
are enumerated as the sets of symbols that may be wrong: a chunk is keyed once by each choice of the
symbols left, and two chunks within the errors agree on one of these keys.

The members of a bucket (equal keys) gather at its pivot, the member that comes first in a
random order.  Buckets with one pivot are one cluster, so a set is sent once to a pivot and not
once to a bucket, and any two members of a bucket meet in a cluster.

Members are compared with their pivot first, and only those that are not linked with it are compared with
all members of the cluster: two members linked with the pivot are in one component already, so a group
of many copies costs as much as it has members.  What is compared is cut into tiles of bounded size, and
pairs of tiles are compared as matrices inside the tasks: first by signature, to leave out members
without any partner within ``distance``, then by their full sets.  A pair of tiles returns a spanning
forest of its confirmed links, which leaves the components as they are, and never the pairs.  Texts with
equal sets are one node from the start.

Defined results: a null or empty text, or one without words, has an empty set, is linked with
nothing and kept; a text with fewer words than a shingle has one shingle of all its words; rows
with a null doc_id come out with it and as components of their own unless their set equals
another's; rows with equal doc_ids are one node if their sets are equal, else linked through it;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from learnlens.llm.shared import Scratch, components, free_name, text_rows

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64
)


@dataclass(frozen=True)
class Near:
    """Parameters of the join."""

    words: int = 5
    similarity: tuple[int, int] = (80, 100)  # a fraction, compared in whole numbers
    symbols: int = 63
    chunks: int = 14
    distance: int = 26
    tile: int = 1000

    @property
    def errors(self) -> int:
        return self.distance // self.chunks

    def missed(self) -> float:
        """Chance that a pair at exactly the similarity differs in more symbols than that."""
        p = 1 - self.similarity[0] / self.similarity[1]
        return sum(
            comb(self.symbols, i) * p**i * (1 - p) ** (self.symbols - i)
            for i in range(self.distance + 1, self.symbols + 1)
        )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Shingler:
    """Sets of hashed word shingles; word hashes are remembered, up to a bound."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        odd = np.resize(_ODD, words) + np.arange(words, dtype=np.uint64) * np.uint64(2)
        self.odd = odd

    def _hash(self, word: bytes) -> int:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > 200_000:
                self.known.clear()
            value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles as sorted 64-bit hashes."""
        # bytes: lower() and split() know the ASCII letters and blanks only
        tokens = (text or "").encode().lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self._hash, tokens), np.uint64, len(tokens))
        size = min(self.words, len(tokens))
        count = len(tokens) - size + 1
        total = np.full(count, np.uint64(size))
        for i in range(size):
            total = total * self.odd[i] + hashes[i : i + count]
            total = total ^ total >> np.uint64(29)
        return np.unique(_mixed(total))


def _seeds(symbols: int) -> np.ndarray:
    steps = np.arange(1, 2 * symbols + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(steps).reshape(2, symbols)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function over the set."""
    least = np.full(seeds.shape[1], np.iinfo(np.uint64).max, np.uint64)
    multiplier = (seeds[1] | np.uint64(1))[:, None]
    for at in range(0, len(shingles), 4096):
        value = (shingles[None, at : at + 4096] ^ seeds[0][:, None]) * multiplier
        value ^= value >> np.uint64(32)
        np.minimum(least, value.min(1), out=least)
    return _mixed(least).astype(np.uint16)


def _choices(near: Near) -> list[tuple[int, np.ndarray]]:
    """The symbols of each key: of a chunk, all but ``errors``."""
    keys = []
    for chunk, places in enumerate(np.array_split(np.arange(near.symbols), near.chunks)):
        left = max(1, len(places) - near.errors)
        keys += [(chunk, np.array(choice)) for choice in combinations(places.tolist(), left)]
    return keys


# 1. nodes ------------------------------------------------------------------------------


def _name(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _nodes(documents: DataFrame, near: Near) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seeds = Shingler(near.words), _seeds(near.symbols)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, names, signs = [], [], []
                for text in part.column("text").to_pylist():
                    own = shingler.shingles(text)
                    sizes.append(len(own))
                    names.append(_name(own))
                    if len(own):
                        signs.append(signature(own, seeds).tobytes())
                    else:
                        signs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(sizes, pa.int64()),
                        pa.array(names, pa.binary()), pa.array(signs, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "same", "signature"],
                )

    return documents.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n_shingles long, same binary, signature binary"
    )


# 2. clusters ---------------------------------------------------------------------------


def _members(nodes: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """``(pivot, node)``: the nodes of all buckets of a pivot, itself included."""
    choices = _choices(near)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if not part.num_rows:
                    continue
                signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16)
                signs = signs.reshape(part.num_rows, -1).astype(np.uint64)
                node = part.column("node").to_numpy()
                for number, (_, places) in enumerate(choices):
                    key = np.full(len(signs), np.uint64(number + 1))
                    for place in places.tolist():
                        key = _mixed(key * _ODD[0] + signs[:, place])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(node)], names=["bucket", "node"]
                    )

    buckets = nodes.select("node", "signature").mapInArrow(keyed, "bucket long, node long")
    # summed on the map side, so a bucket of very many is no single task's
    pivots = buckets.groupBy("bucket").agg(
        F.min_by("node", F.xxhash64("node", F.lit(1))).alias("pivot"), F.count("*").alias("n")
    )
    pivots = scratch.stage(pivots.filter("n > 1").select("bucket", "pivot"), "pivots")
    return buckets.join(pivots, "bucket").select("pivot", "node").distinct()


def _tiled(some: DataFrame, every: DataFrame, near: Near) -> DataFrame:
    """``(pivot, x, y, side, node)``: each tile of ``some`` members beside each tile of ``every`` member."""

    def tiles(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("pivot").agg(F.ceil(F.count("*") / near.tile).cast("int").alias(name))

    both = tiles(some, "nx").join(tiles(every, "ny"), "pivot")

    def dealt(rows: DataFrame, own: str, others: str, side: int) -> DataFrame:
        tile = F.pmod(F.xxhash64("node", F.lit(2)), F.col(f"n{own}")).cast("int")
        beside = F.explode(F.sequence(F.lit(0), F.col(f"n{others}") - 1))
        placed = rows.join(both, "pivot").select("pivot", tile.alias(own), beside.alias(others), "node")
        return placed.select("pivot", "x", "y", F.lit(side).alias("side"), "node")

    return dealt(some, "x", "y", 0).unionByName(dealt(every, "y", "x", 1))


def _pivots(members: DataFrame) -> DataFrame:
    return members.select("pivot").distinct().select("pivot", F.col("pivot").alias("node"))


def _per_tiles(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(table)`` over each pair of tiles, one after another from a sorted partition."""
    key = ["pivot", "x", "y"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
            cuts = [0, *(np.flatnonzero((np.diff(values, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
            if held and tuple(int(held[0].column(c)[0].as_py()) for c in key) != tuple(values[:, 0].tolist()):
                yield from work(pa.Table.from_batches(held))
                held = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(groups, schema)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of either tile."""
    side = table.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _viable(tiled: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """``(pivot, node)`` of the members with a partner within the distance on the other side."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = _sides(table)
        if len(a) == 0 or len(b) == 0:
            return
        node = table.column("node").to_numpy()
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16)
        signs = signs.reshape(table.num_rows, -1)
        near_by = np.zeros(table.num_rows, bool)
        for at in range(0, len(a), 200):
            rows = a[at : at + 200]
            differ = np.zeros((len(rows), len(b)), np.uint8)
            for place in range(near.symbols):
                differ += signs[rows, place][:, None] != signs[b, place][None, :]
            close = (differ <= near.distance) & (node[rows][:, None] != node[b][None, :])
            near_by[rows] |= close.any(1)
            near_by[b] |= close.any(0)
        yield pa.RecordBatch.from_arrays(
            [table.column(c).combine_chunks().filter(pa.array(near_by)) for c in ("pivot", "node")],
            names=["pivot", "node"],
        )

    rows = tiled.join(nodes.select("node", "signature"), "node")
    found = _per_tiles(
        rows.select("pivot", "x", "y", "side", "node", "signature"), work, "pivot long, node long"
    )
    return found.distinct()


# 3. links ------------------------------------------------------------------------------


def _links(tiled: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """``(a, b)``: a spanning forest of the links of each pair of tiles."""
    part, whole = near.similarity

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = _sides(table)
        if len(a) == 0 or len(b) == 0:
            return
        node = table.column("node").to_numpy()
        own = [np.frombuffer(raw, np.uint64) for raw in table.column("shingles").to_pylist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        rows = np.repeat(np.arange(len(own)), size)
        every, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # others are in no intersection
        first = {n: i for i, n in reversed(list(enumerate(node.tolist())))}  # a node may be on both sides
        parent = np.fromiter((first[n] for n in node.tolist()), np.int64, len(node))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        left, right = [], []
        common = np.zeros((len(a), len(b)), np.float32)
        renumber = np.full(len(every), -1)
        for at in range(0, len(shared), 4096):
            some = shared[at : at + 4096]
            renumber[:] = -1
            renumber[some] = np.arange(len(some))
            place = renumber[column]
            hit = place >= 0
            matrix = np.zeros((len(own), len(some)), np.float32)
            matrix[rows[hit], place[hit]] = 1
            common += matrix[a] @ matrix[b].T
        union = size[a][:, None] + size[b][None, :] - common
        linked = (whole * common >= part * union) & (node[a][:, None] != node[b][None, :])
        for i, j in zip(*np.nonzero(linked), strict=True):
            u, v = root(a[i]), root(b[j])
            if u != v:
                parent[u] = v
                left.append(node[a[i]])
                right.append(node[b[j]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
        )

    rows = tiled.join(sets, "node").select("pivot", "x", "y", "side", "node", "shingles")
    return _per_tiles(rows, work, "a long, b long")


def _sets(documents: DataFrame, wanted: DataFrame, near: Near) -> DataFrame:
    """``(node, shingles)`` of the documents that stand for the wanted nodes."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(near.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingler.shingles(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"]
                )

    texts = documents.select(F.col("doc_id").alias("node"), "text").join(wanted, "node")
    return texts.mapInArrow(full, "node long, shingles binary")


def near_duplicates(documents: DataFrame, scratch: Scratch, near: Near | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each document."""
    return _judged(documents, scratch, near or Near()).drop("same")


def _judged(documents: DataFrame, scratch: Scratch, near: Near) -> DataFrame:
    """The rows of ``near_duplicates`` with the name of their set, null for an empty one."""
    signed = scratch.stage(_nodes(documents, near), "signed")
    classes = signed.filter("same IS NOT NULL").groupBy("same").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature")
    )
    classes = scratch.stage(classes, "classes")
    nodes = classes.filter("node IS NOT NULL")

    key = ["pivot", "node"]
    members = scratch.stage(_members(nodes, near, scratch), "members")
    close = scratch.stage(_viable(_tiled(_pivots(members), members, near), nodes, near), "close")
    rest = members.join(close, key, "left_anti").filter("pivot <> node")
    others = scratch.stage(_viable(_tiled(rest, members, near), nodes, near), "others")
    viable = scratch.stage(close.unionByName(others).distinct(), "viable")

    sets = scratch.stage(_sets(documents, viable.select("node").distinct(), near), "sets")
    centres = _pivots(viable).join(viable, key, "left_semi")
    star = scratch.stage(_links(_tiled(centres, viable, near), sets, near), "star")
    linked = star.select(F.col("a").alias("pivot"), F.col("b").alias("node"))
    loose = viable.join(linked, key, "left_anti").join(centres, key, "left_anti")
    links = scratch.stage(_links(_tiled(loose, viable, near), sets, near), "links")
    scratch.drop("sets")
    found = components(star.unionByName(links), scratch)

    own = classes.select("same", "node").join(found, "node", "left").select(
        "same", F.coalesce("component", "node").alias("component_id")
    )
    rows = signed.select("doc_id", "n_shingles", "same").join(own, "same", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"), "same",
    )


def one_of_each(documents: DataFrame, scratch: Scratch, near: Near | None = None) -> DataFrame:
    """The documents that stand for their group: the smallest doc_id of each.  Rows that share a doc_id,
    or have none, are judged one by one, and one of those with equal sets stays."""
    near = near or Near()
    rows = scratch.stage(_judged(documents, scratch, near), "judged")
    name, own = free_name(documents, "gone_id"), free_name(documents, "own_set")
    ids = rows.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(name)).agg(
        F.count("*").alias("n"), F.bool_or("kept").alias("kept")
    )
    apart = scratch.stage(ids.filter("n > 1 OR NOT kept"), "gone")
    with_id = documents.filter(documents["doc_id"].isNotNull())
    single = with_id.join(apart.select(name), documents["doc_id"] == F.col(name), "left_anti")

    shared = with_id.join(apart.filter("kept").select(name), documents["doc_id"] == F.col(name), "left_semi")
    several = shared.unionByName(documents.filter(documents["doc_id"].isNull()))
    several = scratch.stage(_named(several, own, near), "several")
    fit = rows.filter("kept AND same IS NOT NULL").select(F.col("doc_id").alias(name), "same").distinct()
    stay = several.join(
        fit, (F.col(own) == F.col("same")) & several["doc_id"].eqNullSafe(F.col(name)), "left_semi"
    )
    place = free_name(documents, "place")
    first = Window.partitionBy("doc_id", own).orderBy("text")
    stay = stay.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)
    empty = several.filter(F.col(own).isNull())
    return single.unionByName(stay.unionByName(empty).drop(own))


def _named(documents: DataFrame, name: str, near: Near) -> DataFrame:
    """The rows with the name of their set."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(near.words)
        for batch in batches:
            names = [_name(shingler.shingles(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.binary())], names=[*batch.schema.names, name]
            )

    return documents.mapInArrow(named, StructType([*documents.schema.fields, StructField(name, BinaryType())]))
