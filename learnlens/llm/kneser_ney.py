"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model learns from trusted text: all documents labelled good but those held out for the band, however
many there are.  Its n-grams are counted by key, and everything that Kneser-Ney needs of
them (continuation counts, discounts from counts of counts, interpolation weights of contexts)
comes from aggregates and joins on n-gram keys, so no table of the model is held whole anywhere.

Documents are dealt to blocks by hash, in parcels that are compressed before they move.  A block asks for each of its distinct n-grams once; the
distinct n-grams of all blocks are joined with the count tables order by order, from single
characters up; the answers go back to the blocks, where each document's perplexity is taken.

A document is rejected when its log perplexity leaves the band of trusted documents of its language.  The
band reaches from the ``low`` to the ``high`` quantile of the trusted documents that are held out: one in
``aside`` of them, chosen by hash, never trains, whatever the size of the input.  Short
documents get room for the noise of few characters, and the quantiles are taken net of the same room,
so that they are the thresholds at every length.  The model finds what it learned from likelier than any other
text, so the documents that train have bands of their own, from all that train.  Quantiles of a few documents
say nothing: languages with fewer than ``enough`` trusted documents use the band of all.

Defined results: a null or empty text has no perplexity and is kept; a null language is a language of
its own; a null doc_id has no label; rows with equal doc_ids are scored separately; without trusted
documents held out everything that does not train is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.llm.shared import Scratch, expanded, free_name, squeezed, text_rows

UNKNOWN, BEGIN = 0, 1  # numbers of a character outside the alphabet and of the text's beginning
HELD = 4_000_000  # n-grams that a task counts before it sends them
PARCELLED = 32 << 20  # bytes of text that a task holds before it sends parcels
SENT = 1_000_000  # ids that are sent to every executor; more are joined by key
BITS = 16  # of a character's number: an n-gram of four is one key of 64 bits


@dataclass(frozen=True)
class Quality:
    """Parameters of the model and of the decision.

    ``alphabet``: all characters of the trusted texts have their own number, were there as many as 65,534;
    ``others``: a character never seen is one of so many.
    """

    order: int = 4
    alphabet: int = (1 << BITS) - 2
    others: int = 1000
    aside: int = 4
    low: float = 0.01
    high: float = 0.99
    noise: float = 2.5
    enough: int = 30
    block_bytes: int = 16 << 20


def _numbers(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]


def _keys(texts: list[str], table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, and where each text starts."""
    pad = np.full(order - 1, BEGIN, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = []
    for text in texts:
        parts += (pad, _numbers(text, table))
    line = np.concatenate([*parts, pad]) if parts else np.empty(0, np.int64)
    key = np.zeros(len(line), np.int64)
    for back in range(order - 1, -1, -1):
        key <<= BITS
        key[back:] |= line[: len(line) - back] if back else line
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(line), bool)
    for i in range(order - 1):  # the padding before each text, and after the last
        inside[starts + i + np.arange(len(sizes)) * (order - 1)] = False
    if parts:
        inside[len(line) - (order - 1) :] = False
    return key[inside], starts


def _alphabet(texts: DataFrame, size: int) -> np.ndarray:
    """Number of every code point: the commonest ``size`` have their own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for (text,) in text_rows(batches, "text"):
            total += 0 if not text else np.bincount(
                np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), minlength=len(total)
            )
        point = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(total[point])], names=["point", "n"])

    found = texts.select("text").mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    best = found.orderBy(F.desc("n"), "point").limit(size).collect()
    table = np.full(0x110000, UNKNOWN, np.int32)
    for i, row in enumerate(best):
        table[row["point"]] = i + 2
    return table


def _mask(order: int) -> int:
    """The last ``order`` characters of a key, fewer than a whole n-gram."""
    return (1 << BITS * order) - 1


def _train(trusted: DataFrame, table: np.ndarray, model: Quality, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ``order``: ``(key, share)`` of seen n-grams, ``(context, weight)``."""
    shared = trusted.sparkSession.sparkContext.broadcast(table)  # a number per code point

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        held = [nothing]
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            key, code = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, code, np.concatenate([n for _, n in held]))
            return key, total

        def told(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(n[part])], names=["key", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                texts = [t or "" for t in batch.column("text").slice(at, 1000).to_pylist()]
                held.append(np.unique(_keys(texts, shared.value, model.order)[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [added()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from told(*held[0])
                        held, size = [nothing], 0
        yield from told(*added())

    counted = trusted.select("text").mapInArrow(count, "key long, n long")
    counts = scratch.stage(counted.groupBy("key").agg(F.sum("n").alias("n")), f"counts-{model.order}")
    levels = [counts]
    for order in range(model.order - 1, 0, -1):  # how many characters come before an n-gram
        shorter = F.col("key").bitwiseAND(F.lit(_mask(order)))
        counts = levels[-1].groupBy(shorter.alias("key")).agg(F.count("*").alias("n"))
        levels.append(scratch.stage(counts, f"counts-{order}"))

    tables = []
    for order, counts in zip(range(1, model.order + 1), reversed(levels), strict=True):
        few = counts.agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))).first()
        discount = _discounts([few[f"n{i}"] for i in range(1, 5)])
        taken = (
            F.when(F.col("n") == 1, discount[0]).when(F.col("n") == 2, discount[1]).otherwise(discount[2])
        )
        contexts = counts.groupBy(F.shiftrightunsigned("key", BITS).alias("context")).agg(
            F.sum("n").alias("total"), (F.sum(taken) / F.sum("n")).alias("weight")
        )
        contexts = scratch.stage(contexts, f"contexts-{order}")
        shares = (
            counts.withColumn("context", F.shiftrightunsigned("key", BITS))
            .join(contexts, "context")
            .select("key", ((F.col("n") - taken) / F.col("total")).alias("share"))
        )
        tables.append((scratch.stage(shares, f"shares-{order}"), contexts.select("context", "weight")))
    return tables


def _discounts(few: list[int]) -> list[float]:
    """Discounts of n-grams seen once, twice and more often."""
    one, two, three, four = (max(n, 1) for n in few)
    y = one / (one + 2 * two)
    raw = [1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


def _chances(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]], model: Quality, scratch: Scratch) -> DataFrame:
    """``(key, logp)`` of distinct n-grams: interpolated from single characters up."""
    levels = [asked]
    for order in range(model.order - 1, 0, -1):
        levels.append(levels[-1].select(F.col("key").bitwiseAND(F.lit(_mask(order))).alias("key")).distinct())
    lower: DataFrame | None = None
    for order, (shares, contexts) in enumerate(tables, 1):
        keys = levels[model.order - order].withColumns(
            {"context": F.shiftrightunsigned("key", BITS), "suffix": F.col("key").bitwiseAND(F.lit(_mask(order - 1)))}
        )
        found = keys.join(shares, "key", "left").join(contexts, "context", "left")
        if lower is None:
            below = F.lit(1.0 / (model.others + 1))
        else:
            found = found.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * below
        lower = scratch.stage(found.select("key", p.alias("p")), f"chances-{order}")
    return lower.select("key", F.log("p").cast("float").alias("logp"))


_ROWS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def parcels(documents: DataFrame, blocks: int) -> DataFrame:
    """``(block, parcel)``: rows of ``documents`` by the hash of id and text, many in a compressed parcel.

    A shuffle as such hardly compresses prose, and the texts move twice.
    """
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).sort_by("block").combine_chunks()
            where = rows.column("block").to_numpy()
            rows = rows.select(_ROWS.names).cast(_ROWS)
            edges = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
            for start, end in zip(edges, edges[1:], strict=False):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _ROWS) as writer:
                    writer.write_table(rows.slice(start, end - start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(where[start])], pa.int32()), pa.array([squeezed(sink.getvalue())], pa.binary())],
                    names=["block", "parcel"],
                )

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > PARCELLED:
                yield from told()
                held, size = [], 0
        if held:
            yield from told()

    dealt = documents.select("doc_id", "lang", "text", block.alias("block"))
    return dealt.mapInArrow(pack, "block int, parcel binary")


def opened(parcel: pa.Scalar) -> pa.RecordBatch:
    """The rows of a parcel, one batch."""
    rows = pa.ipc.open_stream(expanded(parcel.as_buffer())).read_all().combine_chunks()
    return rows.to_batches()[0]


def log_perplexity(documents: DataFrame, trusted: DataFrame, scratch: Scratch, model: Quality) -> DataFrame:
    """``documents`` (doc_id, lang, text) without text, with ``n_chars`` and ``log_perplexity``."""
    spark = documents.sparkSession
    table = _alphabet(trusted, model.alphabet)
    tables = _train(trusted, table, model, scratch)
    shared = spark.sparkContext.broadcast(table)
    # by the size of the text, so that a block fits a task and asks for as little as it can
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // model.block_bytes) or 1

    dealt = parcels(documents, blocks).repartition("block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for own, parts in held.items():
                key = pd.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), own, np.int32)), pa.array(key)], names=["block", "key"]
                )

        for batch in batches:
            for own, raw in zip(batch.column("block").to_pylist(), batch.column("parcel"), strict=True):
                texts = [t or "" for t in opened(raw).column("text").to_pylist()]
                for at in range(0, len(texts), 500):
                    key = pd.unique(_keys(texts[at : at + 500], shared.value, model.order)[0])
                    held.setdefault(own, []).append(key)
                    size += len(key)
                if size > 8_000_000:
                    held = {own: [pd.unique(np.concatenate(parts))] for own, parts in held.items()}
                    size = sum(len(parts[0]) for parts in held.values())
                    if size > 4_000_000:
                        yield from told()
                        held, size = {}, 0
        yield from told()

    asked = scratch.stage(dealt.mapInArrow(ask, "block int, key long"), "asked")
    chances = _chances(asked.select("key").distinct(), tables, model, scratch)
    answers = asked.join(chances, "key").select("block", "key", "logp")

    def take(docs: Iterator[pa.RecordBatch], found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("logp").to_numpy()) for b in found]
        known = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, np.int64)
        logp = np.concatenate([p for _, p in parts]) if parts else np.empty(0, np.float32)
        order = np.argsort(known)
        known, logp = known[order], logp[order].astype(np.float64)
        for batch in (opened(raw) for parcel in docs for raw in parcel.column("parcel")):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                key, starts = _keys(texts, shared.value, model.order)
                code, distinct = pd.factorize(key)
                sums = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(known, distinct)][code])])
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                total = sums[starts + sizes] - sums[starts]
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = -total / sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("lang"), pa.array(sizes),
                        pa.array(mean, pa.float64(), mask=sizes == 0),
                    ],
                    names=["doc_id", "lang", "n_chars", "log_perplexity"],
                )

    return _per_block(dealt, answers, take)


_OUT = "doc_id long, lang string, n_chars long, log_perplexity double"


def _per_block(dealt: DataFrame, answers: DataFrame, take) -> DataFrame:
    fields = pa.schema(
        [("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("log_perplexity", pa.float64())]
    )

    def table(docs: pa.Table, found: pa.Table) -> pa.Table:
        made = list(take(iter(docs.to_batches()), iter(found.to_batches())))
        return pa.Table.from_batches(made, schema=fields)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(table, _OUT)


def trusted_ids(labels: DataFrame, model: Quality) -> DataFrame:
    """``(doc_id, trained)``: the trusted documents, and whether they train; the others are held out."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(model.aside)) == 0
    return good.select("doc_id", (~held_out).alias("trained"))


def judged(
    documents: DataFrame, labels: DataFrame, scratch: Scratch, model: Quality | None = None
) -> DataFrame:
    """``(doc_id, lang, n_chars, log_perplexity, low, high, kept)`` of every document."""
    model = model or Quality()
    good = scratch.stage(trusted_ids(labels, model), "good")
    train = good.filter("trained").select("doc_id")
    if train.count() <= SENT:  # else texts move, to where their ids are
        train = F.broadcast(train)
    trusted = scratch.stage(
        documents.select("doc_id", "text").filter("text <> ''").join(train, "doc_id", "left_semi").select("text"), "trusted"
    )
    scored = scratch.stage(log_perplexity(documents, trusted, scratch, model), "scored")

    at = F.col("log_perplexity")
    # the noise of a mean over few characters shrinks with the root of their number
    room = model.noise / F.sqrt(F.greatest("n_chars", F.lit(1)))
    marked = scored.join(good, "doc_id", "left")
    known = marked.filter(at.isNotNull() & F.col("trained").isNotNull())
    edges = [
        F.percentile_approx(at + room, model.low, 10_000).alias("lowest"),
        F.percentile_approx(at - room, model.high, 10_000).alias("highest"),
    ]
    every = {row["trained"]: row for row in known.groupBy("trained").agg(*edges).collect()}
    bands = known.groupBy("lang", "trained").agg(F.count("*").alias("n"), *edges)
    bands = bands.filter(F.col("n") >= model.enough).withColumnsRenamed({"lang": "_lang", "trained": "_seen"})
    seen = F.coalesce("trained", F.lit(False))
    with_bands = marked.join(bands, F.col("lang").eqNullSafe(F.col("_lang")) & (seen == F.col("_seen")), "left")

    def edge(name: str, none: float) -> Column:  # none: no such trusted document has a text
        own, other = (every[t][name] if t in every else none for t in (True, False))
        return F.coalesce(name, F.when(seen, own).otherwise(other))

    low, high = edge("lowest", float("-inf")) - room, edge("highest", float("inf")) + room
    return with_bands.select(
        "doc_id", "lang", "n_chars", "log_perplexity",
        low.alias("low"), high.alias("high"),
        F.coalesce((at >= low) & (at <= high), F.lit(True)).alias("kept"),
    )


def kept_documents(documents: DataFrame, labels: DataFrame, scratch: Scratch, model: Quality | None = None) -> DataFrame:
    """The documents that are not rejected; rows of one doc_id stand or fall by their own scores
    when these agree, and stay when any of them does."""
    verdict = judged(documents, labels, scratch, model)
    rejected = verdict.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept")
    name = free_name(documents, "rejected_id")
    rejected = scratch.stage(rejected.select(F.col("doc_id").alias(name)), "rejected")
    return documents.join(rejected, documents["doc_id"].eqNullSafe(rejected[name]), "left_anti")
