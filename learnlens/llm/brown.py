"""Brown class-based n-grams.

Words get classes by exchange clustering, and a text is scored by class transitions and word
emissions: ``p(w | h) = (1 - e) * p(class(w) | classes of h) * p(w | class(w))`` for a word of the
training texts, and ``p(unknown | h) = e``, the Good-Turing share of words seen once.  Transitions are
class trigrams smoothed by bigrams and unigrams.  Known words and one unknown word share all
probability, as in the add-one base score.

1. Words are counted by hash shards.
2. The ``clustered`` most frequent words are exchanged: from counts of neighbouring pairs, workers
   move each of their words to the class that raises the likelihood most, given the classes of
   the others at the start of the pass (the parallel form of the exchange).  The number of
   these words is a parameter of the model, and so is that of the workers.
3. All other words, however rare, then take the class that suits their neighbours best, in their
   shards.
4. Documents are blocks of local word numbers; shards answer for a block's words with count and
   class; transitions are counted over all training documents and every text is scored.

Memory of a task is a block, a shard or the tables of ``classes`` and ``clustered``; the driver gets those
tables alone.

Defined results: a null or empty text is its end alone; a null doc_id is a training text; rows with
equal doc_ids are separate texts; without training texts every score is 0; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.llm import blocks
from learnlens.llm.shared import Scratch, cut, packed, text_rows, unpacked, width

END = b"\n"  # no word holds white space
REST, ENDED = 0, 1  # classes of unclustered words (during the exchange) and of the end


def words_of(text: str) -> list[bytes]:
    # bytes: lower() and split() know the ASCII letters and blanks only
    return text.encode().lower().split()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@dataclass(frozen=True)
class Brown:
    """Parameters of the model."""

    classes: int = 40
    clustered: int = 16_384
    passes: int = 5
    workers: int = 16
    bigram_weight: float = 20.0
    trigram_weight: float = 20.0


def _tokens(text: str | None) -> list[bytes]:
    words = words_of(text or "")
    words.append(END)
    return words


# 1. words ------------------------------------------------------------------------------


def _vocabulary(documents: DataFrame, shards: int) -> DataFrame:
    """TABLE parcels: the words of a shard and how often they occur in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def finished() -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            numbers = np.fromiter(counts.values(), np.int64, len(keys))
            for shard, places in blocks.sharded(keys, shards):
                columns = blocks.key_columns(keys, places)
                columns["nums"] = numbers[places].tobytes()
                yield blocks.batch_of([blocks.parcel(blocks.TABLE, None, shard, **columns)])

        for doc_id, text in text_rows(batches, "doc_id", "text"):
            if not held_out(doc_id):
                counts.update(_tokens(text))
                if len(counts) > 500_000:
                    yield from finished()
                    counts = Counter()
        yield from finished()

    def add(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in own:
            keys = cut(part["keys"], unpacked(part["lens"]))
            counts.update(dict(zip(keys, np.frombuffer(part["nums"], np.int64).tolist(), strict=True)))
            shard = part["shard"]
        keys = list(counts)
        columns = blocks.key_columns(keys, np.arange(len(keys)))
        columns["nums"] = np.fromiter(counts.values(), np.int64, len(keys)).tobytes()
        yield blocks.batch_of([blocks.parcel(blocks.TABLE, None, shard, **columns)])

    counted = documents.select("doc_id", "text").mapInArrow(count, blocks.PARCEL)
    return blocks.by(counted, "shard", add)


def _frequent(vocabulary: DataFrame, number: int) -> tuple[list[bytes], list[int], int, int, int]:
    """The most frequent words and their counts; all tokens, distinct words, words seen once."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lens, nums in text_rows(batches, "keys", "lens", "nums"):
            counts = np.frombuffer(nums, np.int64)
            words = cut(keys, unpacked(lens))
            yield _counted([None], [int(counts.sum())], [len(words)], [int((counts == 1).sum())])
            best = np.argsort(-counts, kind="stable")[:number].tolist()
            best = [i for i in best if words[i] != END]
            yield _counted([words[i] for i in best], counts[best], [0] * len(best), [0] * len(best))

    def _counted(words, counts, kinds, once):
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), *(pa.array(c, pa.int64()) for c in (counts, kinds, once))],
            names=["word", "n", "distinct", "once"],
        )

    rows = vocabulary.mapInArrow(top, "word binary, n long, distinct long, once long")
    totals = rows.filter("word IS NULL").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "distinct", "once"))
    ).first()
    best = rows.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(number).collect()
    return [bytes(r["word"]) for r in best], [r["n"] for r in best], totals["n"], totals["distinct"], totals["once"]


# 2. the exchange -----------------------------------------------------------------------


def _pairs(documents: DataFrame, words: list[bytes]) -> DataFrame:
    """Counts of neighbours, as numbers: 0 a word outside ``words``, 1 the end, then ``words``."""
    count = len(words) + 2
    shared = documents.sparkSession.sparkContext.broadcast(words)  # ``clustered`` words

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {word: i + 2 for i, word in enumerate(shared.value)}
        number[END] = 1
        held, size = [np.ones(1, np.int64)], 1

        def summed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            codes, n = np.unique(ids[:-1] * count + ids[1:], return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(codes // count), pa.array(codes % count), pa.array(n)], names=["l", "r", "n"]
            )

        for doc_id, text in text_rows(batches, "doc_id", "text"):
            if held_out(doc_id):
                continue
            tokens = _tokens(text)
            held.append(np.fromiter((number.get(t, 0) for t in tokens), np.int64, len(tokens)))
            size += len(tokens)
            if size > 4_000_000:
                yield summed()
                held, size = [np.ones(1, np.int64)], 1
        if size > 1:
            yield summed()

    found = documents.select("doc_id", "text").mapInArrow(pair, "l long, r long, n long")
    return found.groupBy("l", "r").agg(F.sum("n").alias("n"))


def _neighbours(pairs: DataFrame, classes: np.ndarray, k: int, workers: int) -> DataFrame:
    """``(worker, stats)``: of each word of a worker, how often each class precedes and follows."""
    count = len(classes)
    own_words = -(-count // workers)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(workers * own_words * 2 * k, np.int64)
        held: list[tuple] = []

        def flush() -> None:
            left, right, n = (np.concatenate(c) for c in zip(*held, strict=True))
            for word, other, side in ((right, left, 0), (left, right, 1)):
                place = (word % workers * own_words + word // workers) * 2 * k + side * k + classes[other]
                total[:] += np.bincount(place, weights=n, minlength=len(total)).astype(np.int64)
            held.clear()

        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("l", "r", "n")))
            size += batch.num_rows
            if size > 2_000_000:
                flush()
                size = 0
        if held:
            flush()
        parts = total.reshape(workers, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(workers)), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["worker", "stats"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for worker, stats in text_rows(batches, "worker", "stats"):
            part = np.frombuffer(stats, np.int64)
            totals[worker] = totals[worker] + part if worker in totals else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int64()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
            names=["worker", "stats"],
        )

    ddl = "worker long, stats binary"
    return pairs.mapInArrow(tally, ddl).repartition(workers, "worker").mapInArrow(add, ddl)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _exchange(stats: np.ndarray, own: np.ndarray, classes: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """New classes of the words ``own``, most frequent first; ``table``: counts of class pairs.

    The likelihood of a clustering is the sum of x log x over class pairs less that over classes as
    left and as right neighbour.  A word is taken out of its class and put where the sum grows most.
    """
    table = table.astype(np.float64).copy()
    new = classes[own].copy()
    free = np.arange(2, k)
    for i, _ in enumerate(own):
        before, after = stats[i, :k].astype(np.float64), stats[i, k:].astype(np.float64)
        if not before.any():
            continue
        old = new[i]
        table[:, old] -= before
        table[old, :] -= after
        np.maximum(table, 0, out=table)  # contexts within the class are counted on both sides
        put_right = _xlogx(table + before[:, None]) - _xlogx(table)  # as right neighbour of b
        put_left = _xlogx(table + after[None, :]) - _xlogx(table)
        right_total, left_total = table.sum(0), table.sum(1)
        gain = (
            put_right.sum(0)
            + put_left.sum(1)
            - (_xlogx(right_total + before.sum()) - _xlogx(right_total))
            - (_xlogx(left_total + after.sum()) - _xlogx(left_total))
        )
        best = free[np.argmax(gain[free])]
        new[i] = best
        table[:, best] += before
        table[best, :] += after
    return new


def _cluster(pairs: DataFrame, words: int, model: Brown, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of 0 (rest), 1 (end) and the clustered words; counts of class pairs."""
    k, workers = model.classes, model.workers
    classes = np.concatenate([[REST, ENDED], 2 + np.arange(words) % (k - 2)]).astype(np.int64)
    count = len(classes)
    own_words = -(-count // workers)

    def owned(worker: int) -> np.ndarray:
        return np.arange(worker, count, workers)

    def class_pairs(stats: DataFrame, classes: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for worker, raw in text_rows(batches, "worker", "stats"):
                words = owned(worker)
                after = np.frombuffer(raw, np.int64).reshape(own_words, 2, k)[: len(words), 1]
                part = np.zeros((k, k), np.int64)
                np.add.at(part, classes[words], after)
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["part"])

        parts = stats.mapInArrow(add, "part binary").collect()  # one table of classes a worker
        return sum((np.frombuffer(r["part"], np.int64).reshape(k, k) for r in parts), np.zeros((k, k), np.int64))

    for turn in range(model.passes + 1):
        stats = scratch.stage(_neighbours(pairs, classes, k, workers), f"stats-{turn}")
        table = class_pairs(stats, classes)
        if turn == model.passes:
            break

        def move(batches: Iterator[pa.RecordBatch], classes=classes, table=table) -> Iterator[pa.RecordBatch]:
            for worker, raw in text_rows(batches, "worker", "stats"):
                words = owned(worker)
                part = np.frombuffer(raw, np.int64).reshape(own_words, -1)[: len(words)]
                movable = words >= 2  # numbers go by falling frequency
                new = _exchange(part[movable], words[movable], classes, table, k)
                yield pa.RecordBatch.from_arrays([pa.array(words[movable]), pa.array(new)], names=["word", "class"])

        classes = classes.copy()
        for row in stats.mapInArrow(move, "word long, class long").collect():  # ``clustered`` rows
            classes[row["word"]] = row["class"]
    return classes, table


# 3. and 4. all words, all texts --------------------------------------------------------


def _contexts(block: blocks.Block, keys: list[bytes], classes: dict[bytes, int], k: int):
    """KEYS columns: the classes next to each unclustered word in the block's training texts."""
    own = np.fromiter((classes.get(w, REST) for w in keys), np.int64, len(keys))
    rare = np.fromiter((w not in classes for w in keys), bool, len(keys))
    train = [c for c, d in zip(block.codes, block.ids, strict=True) if not held_out(d)]
    if train:
        codes = np.concatenate(train).astype(np.int64)
        around = np.concatenate([[ENDED], own[codes], [ENDED]])
        seen = np.flatnonzero(rare[codes])
        word = codes[seen]
        entry = np.concatenate([word * 2 * k + around[seen], word * 2 * k + k + around[seen + 2]])
        entry, n = np.unique(entry, return_counts=True)
    else:
        entry, n = np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.searchsorted(entry, np.arange(len(keys) + 1) * 2 * k)

    def columns(places: np.ndarray) -> dict:
        sizes = starts[places + 1] - starts[places]
        stops = np.cumsum(sizes)
        pick = np.arange(int(stops[-1])) + np.repeat(starts[places] - (stops - sizes), sizes)
        return {"nums": packed(np.concatenate([sizes, entry[pick] % (2 * k), n[pick]]))}

    return columns


def _classified(asked: DataFrame, vocabulary: DataFrame, top: dict[bytes, int], table: np.ndarray, model: Brown) -> DataFrame:
    """TABLE parcels: the words of a shard, how often they occur and their classes.

    The contexts that blocks send are added up as they come, so a shard holds its words alone.
    """
    k = model.classes
    joint = table + 0.5
    transit = np.log(joint / joint.sum(1, keepdims=True))
    weight = np.log(joint.sum(0) / joint.sum())
    shared = asked.sparkSession.sparkContext.broadcast(top)  # ``clustered`` words

    def classify(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        known, words, counts = shared.value, [], b""
        number: dict[bytes, int] = {}
        for got in own:
            keys = cut(got["keys"], unpacked(got["lens"]))
            if got["kind"] == blocks.TABLE:
                shard, words, counts = got["shard"], keys, bytes(got["nums"])
                number = {w: i for i, w in enumerate(words)}
                stats = np.zeros((len(words), 2 * k), np.float32)
                continue
            nums = unpacked(got["nums"]).astype(np.int64)
            sizes, rest = nums[: len(keys)], nums[len(keys) :]
            if len(rest):
                place = np.fromiter((number.get(w, -1) for w in keys), np.int64, len(keys))
                entry, n = rest[: len(rest) // 2], rest[len(rest) // 2 :]
                np.add.at(stats, (np.repeat(place, sizes), entry), n)
        if not words:
            return
        # the class whose neighbours fit best, for its share of all words
        fit = stats[:, :k] @ transit[:, 2:] + stats[:, k:] @ transit[2:].T - stats[:, :k].sum(1)[:, None] * weight[2:]
        chosen = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        chosen = np.where(chosen >= 0, chosen, fit.argmax(1) + 2)
        chosen[np.fromiter((w == END for w in words), bool, len(words))] = ENDED
        columns = blocks.key_columns(words, np.arange(len(words)))
        columns |= {"codes": counts, "nums": chosen.astype(np.uint8).tobytes()}
        yield blocks.batch_of([blocks.parcel(blocks.TABLE, None, shard, **columns)])

    return blocks.by(asked.unionByName(vocabulary), "shard", classify)


def _answers(asked: DataFrame, tables: DataFrame, model: Brown) -> DataFrame:
    """KEYS parcels with the count and class of each word that a block asks for, one after another."""

    def answer(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        counts, classes = np.zeros(1, np.int64), np.full(1, model.classes, np.uint8)
        for got in own:
            keys = cut(got["keys"], unpacked(got["lens"]))
            if got["kind"] == blocks.TABLE:
                number = {w: i for i, w in enumerate(keys)}
                # a word that no training text holds is behind the others
                counts = np.append(np.frombuffer(got["codes"], np.int64), 0)
                classes = np.append(np.frombuffer(got["nums"], np.uint8), model.classes).astype(np.uint8)
                continue
            place = np.fromiter((number.get(w, -1) for w in keys), np.int64, len(keys))
            columns = {"codes": bytes(got["codes"]), "lens": counts[place].tobytes(), "nums": classes[place].tobytes()}
            yield blocks.batch_of([blocks.parcel(blocks.KEYS, got["block"], got["shard"], **columns)])

    columns = [c.split()[0] for c in blocks.PARCEL.split(", ")]
    plain = asked.withColumn("nums", F.lit(None).cast("binary")).select(*columns)
    return blocks.by(plain.unionByName(tables), "shard", answer)


def _class_totals(table: DataFrame, k: int) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + 1, np.int64)
        for codes, nums in text_rows(batches, "codes", "nums"):
            np.add.at(total, np.frombuffer(nums, np.uint8), np.frombuffer(codes, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = table.mapInArrow(add, "part binary").groupBy("part").count().collect()
    return sum((np.frombuffer(r["part"], np.int64) * r["count"] for r in parts), np.zeros(k + 1, np.int64))


_ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary, trigrams binary"


def _emissions(answers: DataFrame, docs: DataFrame, totals: np.ndarray, tokens: int, distinct: int, k: int) -> DataFrame:
    """Per text: base score, log10 emissions and classes; per block: counts of class trigrams."""
    floor = float(np.log10(tokens + distinct + 1))

    def join(own: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        places, counts, classes = [], [], []
        for got in own:
            if got["kind"] == blocks.KEYS:
                places.append(blocks.places_of(got))
                counts.append(np.frombuffer(got["lens"], np.int64))
                classes.append(np.frombuffer(got["nums"], np.uint8))
                continue
            place = np.concatenate(places)
            count, own_class = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
            count[place], own_class[place] = np.concatenate(counts), np.concatenate(classes)
            base = np.log10(count + 1) - floor
            emit = np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(totals[own_class], 1)), 0.0)
            codes, sizes = unpacked(got["codes"]), unpacked(got["lens"]).astype(np.int64)
            starts = np.cumsum(sizes) - sizes  # no text is without its end
            word_class = own_class[codes]
            known = count[codes] > 0
            held = [held_out(d) for d in got["ids"]]
            yield _emitted(
                got["ids"], held, sizes, np.add.reduceat(known.astype(np.int64), starts),
                np.add.reduceat(base[codes], starts), np.add.reduceat(emit[codes], starts),
                [c.tobytes() for c in np.split(word_class, starts[1:])], None,
            )
            train = np.repeat(~np.array(held, bool), sizes)
            history = _histories(word_class, starts, k)
            index, n = np.unique(history[train], return_counts=True)
            yield _emitted([None], [None], [None], [None], [None], [None], [None], [index.astype("<i8").tobytes() + n.astype("<i8").tobytes()])

    def _emitted(ids, held, sizes, known, base, emit, classes, trigrams):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()),
                pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(emit, pa.float64()),
                pa.array(classes, pa.binary()), pa.array(trigrams or [None] * len(ids), pa.binary()),
            ],
            names=[c.split()[0] for c in _ROW.split(", ")],
        )

    return blocks.by(answers.unionByName(docs), "block", join, _ROW)


def _histories(classes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Number of the class trigram that ends at each word; texts begin after two ends."""
    c = classes.astype(np.int64)
    last = np.concatenate([[ENDED], c[:-1]])
    last[starts] = ENDED
    second = np.concatenate([[ENDED], last[:-1]])
    second[starts] = ENDED
    return (second * (k + 1) + last) * (k + 1) + c


def _transitions(rows: DataFrame, model: Brown) -> np.ndarray:
    """Smoothed log10 p(class | two classes before); class ``classes`` is an unknown word."""
    k = model.classes + 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k**3, np.int64)
        for (raw,) in text_rows(batches, "trigrams"):
            index, n = np.frombuffer(raw, "<i8").reshape(2, -1)
            total[index] += n
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total[index])], names=["index", "n"])

    counts = np.zeros(k**3)
    found = rows.filter("trigrams IS NOT NULL").select("trigrams").mapInArrow(spread, "index long, n long")
    for row in found.groupBy("index").agg(F.sum("n").alias("n")).collect():  # at most (classes + 1) ** 3
        counts[row["index"]] = row["n"]
    three = counts.reshape(k, k, k)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.1 * (np.arange(k) < k - 1)) / max(one.sum() + 0.1 * (k - 1), 1e-9)
    a, b = model.bigram_weight, model.trigram_weight
    p2 = (two + a * p1) / (two.sum(1, keepdims=True) + a)
    p3 = (three + b * p2) / (three.sum(2, keepdims=True) + b)
    with np.errstate(divide="ignore"):
        return np.log10(p3)


@dataclass(frozen=True)
class Fitted:
    """A model over a table: counts of the training texts, classes, transitions and what each text emits."""

    model: Brown
    tokens: int
    distinct: int
    once: int
    table: DataFrame  # TABLE parcels: words, how often they occur and their classes
    rows: DataFrame
    chances: np.ndarray

    @property
    def unknown(self) -> float:
        return (self.once + 1) / (self.tokens + 2) if self.tokens else 1.0


def fit(documents: DataFrame, scratch: Scratch, model: Brown | None = None) -> Fitted:
    model = model or Brown()
    k = model.classes
    shards = width(documents.sparkSession)
    vocabulary = scratch.stage(_vocabulary(documents, shards), "words")
    words, _, tokens, distinct, once = _frequent(vocabulary, model.clustered)
    pairs = scratch.stage(_pairs(documents, words), "pairs")
    classes, table = _cluster(pairs, len(words), model, scratch)
    scratch.drop("pairs")
    top = dict(zip(words, classes[2:].tolist(), strict=True)) | {END: ENDED}

    shared = documents.sparkSession.sparkContext.broadcast(top)  # ``clustered`` words
    parcels = scratch.stage(
        blocks.coded(
            documents,
            _tokens,
            shards,
            extra=lambda block, keys: _contexts(block, keys, shared.value, k),
        ),
        "blocks",
        by=["kind"],
    )
    columns = [c.split()[0] for c in blocks.PARCEL.split(", ")]
    asked = parcels.filter(f"kind = {blocks.KEYS}").select(*columns)
    tables = scratch.stage(_classified(asked, vocabulary, top, table, model), "classes")
    answers = scratch.stage(_answers(asked, tables, model), "answers")
    totals = _class_totals(tables, k)
    docs = parcels.filter(f"kind = {blocks.DOCS}").select(*columns)
    rows = scratch.stage(_emissions(answers, docs, totals, tokens, distinct, k), "emissions")
    scratch.drop("blocks")
    scratch.drop("answers")
    chances = _transitions(rows, model) if tokens else np.zeros((k + 1, k + 1, k + 1))
    return Fitted(model, tokens, distinct, once, tables, rows, chances)


def classes_of(fitted: Fitted) -> dict[bytes, int]:
    """The class of every word, on the driver: for small tables."""
    found = {}
    for row in fitted.table.select("keys", "lens", "nums").collect():
        found |= dict(zip(cut(row["keys"], unpacked(row["lens"])), row["nums"], strict=True))
    return found


def scored(fitted: Fitted) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every text."""
    k, tokens, unknown, chances = fitted.model.classes, fitted.tokens, fitted.unknown, fitted.chances

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = chances.ravel()
        hit, miss = (np.log10(1 - unknown) if tokens else 0.0), np.log10(unknown)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("n_tokens").to_numpy()
            seen = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8)
            starts = np.cumsum(sizes) - sizes
            step = np.where(seen < k, flat[_histories(seen, starts, k)] + hit, miss)
            scores = np.add.reduceat(step, starts) + batch.column("emitted").to_numpy()
            kept = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([tokens] * len(sizes), pa.int64()), batch.column("base_score"), pa.array(scores)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return fitted.rows.filter("trigrams IS NULL").drop("trigrams").mapInArrow(
        finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def score(documents: DataFrame, scratch: Scratch, model: Brown | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every text."""
    return scored(fit(documents, scratch, model))
