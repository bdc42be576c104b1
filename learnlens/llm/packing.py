"""Best-fit packing of tokenized documents, by linear grouping.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut.  A length is
a number from 1 to ``capacity``, so the table of counts per length is of fixed size however many
documents there are, and the plan is made from that table alone:

1. large lengths are dealt, longest first, into groups of equal cardinality, and every length in a
   group is rounded up to the longest of it, so there are few sizes;
2. configurations of these sizes are optimised: a linear program over all configurations that fit, solved
   by column generation (a bounded knapsack over the dual values gives the next column), and each
   is used as often as the solution, rounded down, says;
3. documents take the places of the rounded sizes: the longest left that is no longer than the size, and in
   the last place the longest large ones that fit; a run of sequences that got the same lengths is one step;
4. what is left, and all small ones, go longest first by best fit into the free space, then into new
   sequences.

The plan is a list of runs: ranks of a length, and the sequences and offsets they go to.  Pieces
learn their rank from their place in their block and the counts of earlier blocks, and look
up their run.  No task sees more than a block of pieces.

Defined results: a null or empty text is a document of the end id alone; a null doc_id stays null;
rows with equal doc_ids are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.shared import Scratch, text_rows
from learnlens.llm.tokens import hugging_table


class Run(NamedTuple):
    """Ranks ``first`` to ``first + number - 1`` of a length: ``each`` to a sequence."""

    length: int
    first: int
    number: int
    sequence: int
    each: int
    offset: int


def _grouped(counts: dict[int, int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, rounded up within groups of equal cardinality, and how many pieces have each."""
    share = -(-sum(counts.values()) // groups)
    demand: dict[int, int] = {}
    room, size = 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                room, size = share, length
            used = min(left, room)
            demand[size] = demand.get(size, 0) + used
            left, room = left - used, room - used
    return np.array(list(demand), np.int64), np.array(list(demand.values()), np.float64)


def _fullest(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration, with at most ``most`` of each size."""
    best, steps = np.zeros(capacity + 1), []
    for group in range(len(sizes)):
        left, taken = int(min(most[group], capacity // sizes[group])), 1
        while left > 0 and values[group] > 1e-12:
            number = min(taken, left)
            wide = number * int(sizes[group])
            more = best[: capacity + 1 - wide] + number * values[group]
            better = more > best[wide:] + 1e-12
            best[wide:] = np.where(better, more, best[wide:])
            steps.append((group, number, wide, better))
            left, taken = left - number, 2 * taken
    chosen, room = np.zeros(len(sizes), np.int64), capacity
    for group, number, wide, better in reversed(steps):
        if room >= wide and better[room - wide]:
            chosen[group] += number
            room -= wide
    return float(best[capacity]), chosen


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000):
    """Configurations, and how often the linear program uses each: the demand is met by the fewest sequences."""
    start = np.minimum(capacity // sizes, demand)
    columns = np.diag(start).astype(np.int64)
    inverse, uses = np.diag(1 / start), demand / start
    for _ in range(rounds):  # every round is a better plan, so it may end at any of them
        value, column = _fullest(sizes, inverse.sum(0), demand, capacity)
        if value <= 1 + 1e-6:
            break
        along = inverse @ column
        ratio = np.where(along > 1e-9, uses / np.where(along > 1e-9, along, 1), np.inf)
        leaves = int(np.argmin(ratio))
        uses = np.maximum(uses - ratio[leaves] * along, 0)
        uses[leaves] = ratio[leaves]
        columns[:, leaves] = column
        row = inverse[leaves] / along[leaves]
        inverse = inverse - np.outer(along, row)
        inverse[leaves] = row
    return columns.T, uses


def plan(counts: dict[int, int], capacity: int, groups: int = 100, small: int = 128) -> list[Run]:
    """Runs that place every piece of the table ``length -> number``."""
    runs: list[Run] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, number)
    levels: list[int] = []
    left = np.zeros(capacity + 1, np.int64)
    for length, number in counts.items():
        left[length] = number
    ranks = np.zeros(capacity + 1, np.int64)
    made = 0

    def leave(space: int, sequence: int, number: int) -> None:
        if space and number:
            if space not in free:
                insort(levels, space)
            free.setdefault(space, []).append((sequence, number))

    def take(length: int, number: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(length, int(ranks[length]), number, sequence, each, offset))
        ranks[length] += number
        left[length] -= number

    def longest(limit: int) -> int:
        """The longest large piece left."""
        there = np.flatnonzero(left[small + 1 : limit + 1])
        return small + 1 + int(there[-1]) if len(there) else 0

    def filled(slots: list[int]) -> list[int]:
        """The lengths of one sequence: taken from what is left, and put back."""
        lengths, space = [], capacity
        for size in [*(min(s, capacity) for s in slots[:-1]), capacity]:
            while length := longest(min(size, space)):
                lengths.append(length)
                left[length] -= 1
                space -= length
                if size < capacity:
                    break
        for length in lengths:
            left[length] += 1
        return lengths

    if left[capacity]:
        made = int(left[capacity])
        take(capacity, made, 0, 1, 0)

    large = {n: int(left[n]) for n in range(small + 1, capacity) if left[n]}
    if large:
        sizes, demand = _grouped(large, groups)
        configurations, uses = _configurations(sizes, demand, capacity)
        for chosen in np.argsort(-uses, kind="stable"):
            times = int(uses[chosen] + 1e-6)
            slots = sorted(np.repeat(sizes, configurations[chosen]).tolist(), reverse=True)
            while times and (lengths := filled(slots)):
                number = min(times, *(int(left[n]) // lengths.count(n) for n in lengths))
                offset = 0
                for length in lengths:
                    take(length, number, made, 1, offset)
                    offset += length
                leave(capacity - offset, made, number)
                made, times = made + number, times - number

    for length in np.flatnonzero(left)[::-1].tolist():
        while rest := int(left[length]):
            at = bisect_left(levels, length)
            if at == len(levels):
                number = -(-rest // (capacity // length))
                leave(capacity, made, number)
                made += number
                continue
            space = levels[at]
            sequence, number = free[space].pop()
            if not free[space]:
                del free[space]
                levels.pop(at)
            each = min(space // length, rest)
            times = min(number, rest // each)
            take(length, each * times, sequence, each, capacity - space)
            leave(space - each * length, sequence, times)
            leave(space, sequence + times, number - times)
    return runs


def pieces_of(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes what is left over."""
    head = (size - 1) % capacity + 1
    return [(0, head), *((at, capacity) for at in range(head, size, capacity))]


_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("block", pa.int64()),
        ("place", pa.int64()),
    ]
)
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, place long"


def pack(
    documents: DataFrame,
    scratch: Scratch,
    tokenizer: str,
    kind: str = "byte_level",
    end_id: int = 2,
    capacity: int = 1024,
    groups: int = 100,
    small: int = 128,
    keep_table: bool = False,
    chunks: int = 200_000,
) -> DataFrame:
    """A row per piece: where it is in its document, and in which sequence.

    ``keep_table``: workers keep their table of chunks for their next task, for more memory;
    ``chunks``: how many distinct chunks a table holds before it keeps only the most used half.
    """

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hugging_table(tokenizer, kind, limit=chunks)
        # a block is what one task emits at a time; its number is unique and, with the
        # pieces, written once
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                names = [row for row, _ in text_rows(iter([part]), "doc_id", "text")]
                rows, places = [], {}
                for doc_id, ids in zip(names, table.ids(part.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for number, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                        place = places[length] = places.get(length, -1) + 1
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        rows.append((doc_id, number, start, length, crc, block, place))
                block += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)],
                    schema=_PIECE,
                )
        if not keep_table:
            table.clear()

    pieces = scratch.stage(
        documents.select("doc_id", "text").mapInArrow(tokenized, _PIECE_DDL), "pieces"
    )

    by_block = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    by_block = scratch.stage(by_block, "counts")
    counts = {
        row["length"]: row["n"]
        for row in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()  # <= capacity
    }
    placed = _lookup(plan(counts, capacity, groups, small))

    # blocks of a task follow each other: sums over tasks, then within each
    task, none = F.shiftright("block", 32).alias("task"), F.lit(0)
    before_it = (Window.unboundedPreceding, -1)
    by_task = by_block.groupBy("length", task).agg(F.sum("n").alias("n"))
    tasks = Window.partitionBy("length").orderBy("task").rowsBetween(*before_it)
    begun = by_task.select("length", "task", F.coalesce(F.sum("n").over(tasks), none).alias("begun"))
    blocks = Window.partitionBy("length", "task").orderBy("block").rowsBetween(*before_it)
    before = (
        by_block.withColumn("task", task)
        .join(begun.hint("merge"), ["length", "task"])
        .select("block", "length", (F.col("begun") + F.coalesce(F.sum("n").over(blocks), none)).alias("before"))
    )
    ranked = pieces.join(before.hint("merge"), ["block", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            sequence, offset = placed(lengths, batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank"
    ).mapInArrow(place, out)


def _lookup(runs: list[Run]):
    """A function from lengths and ranks to sequences and offsets."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    wide = np.int64(1) << 48  # ranks stay below it
    keys = table[:, 0] * wide + table[:, 1]

    def find(lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = table[np.searchsorted(keys, lengths * wide + ranks, side="right") - 1]
        nth = ranks - run[:, 1]
        return run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * lengths

    return find
