"""BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges give.  It starts
as one state with an arc for every base symbol, and takes the merges one after another.  The gadget
of a merge ``(u, v)``: wherever an arc ``u`` leads to a state with an arc ``v``, a new arc ``uv`` goes
straight to where the two led, and the arcs ``u`` now lead to a copy of that state without the arc ``v``.

All arcs of one token lead to one state at any time, so a state is named by the token read last, and its
row says which arcs it lacks.  A state lacks the arc ``uv`` if it lacked ``u`` when that merge came, so
what the loss of an arc ``v`` takes with it are the tokens that begin with ``v`` by later merges.  Tokens are
numbered such that these follow ``v`` without a gap (a walk over the tree of left parts, the latest merge
first); a row is then a short sorted list of number ranges, and one binary search is a transition.

All states accept, so every beginning of a word has one path.  Encoding goes through a word once and
finds the last arc of the path to each place among the tokens that end there; the ids are the labels
of the last path.  Decoding emits the labels of the arcs.

The table is compiled on the driver and broadcast: its size follows the file of merges alone.

Defined results: a null or empty text has no ids and decodes to an empty text; strings of added tokens
are these tokens, as the library has it; rows keep their doc_id whatever it is, also null or repeated; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from learnlens.llm.shared import Scratch, text_rows
from learnlens.llm.tokens import ChunkTable, around_added, blank_chunks, byte_level_chunks, byte_level_text


class Automaton:
    """``base``: the symbols words are made of, ``merges``: pairs in their order, ``suffix``: what the last
    symbol of a word has at its end."""

    def __init__(self, base: Sequence[str], merges: Sequence[tuple[str, str]], ids: dict[str, int], suffix: str = ""):
        names = [*base, *(u + v for u, v in merges)]
        number = {name: i for i, name in enumerate(names)}
        if len(number) < len(names):
            raise ValueError("two merges give the same token")
        first = len(base)
        pairs = [(number[u], number[v]) for u, v in merges]
        if any(max(pair) >= first + rule for rule, pair in enumerate(pairs)):
            raise ValueError("a merge uses a token that a later merge makes")
        self.suffix, self.labels = suffix, {ids[name]: name for name in names}

        # places in the walk, and how far the loss of v by a merge reaches
        size, later = [1] * len(names), [0] * len(names)
        shift, reach = [0] * len(pairs), [0] * len(pairs)
        for rule in range(len(pairs) - 1, -1, -1):
            u, v = pairs[rule]
            shift[rule] = later[u]
            size[u] += size[first + rule]
            later[u] += size[first + rule]
            reach[rule] = 1 + later[v]
        place, at = [0] * len(names), 0
        for symbol in range(first):
            place[symbol], at = at, at + size[symbol]
        for rule, (u, _) in enumerate(pairs):
            place[first + rule] = place[u] + 1 + shift[rule]

        # the gadgets, one after another; rows are copied when they change
        empty = array("i")
        rows = [empty] * first
        live = [True] * first
        for rule, (u, v) in enumerate(pairs):
            row = rows[u]
            cut = bisect_right(row, place[v])
            rows.append(rows[v])
            live.append(live[u] and live[v] and not cut & 1)
            if live[-1]:
                rows[u] = row[:cut] + array("i", (place[v], place[v] + reach[rule])) + row[cut:]
        self.start = empty
        self.arcs: dict = {}  # the tokens by their last symbols: a node is {symbol: node}, "" its arc
        for name, i in number.items():
            if live[i]:
                node = self.arcs
                for symbol in reversed(self._symbols(name)):
                    node = node.setdefault(symbol, {})
                node[""] = (place[i], rows[i], ids[name])

    def _symbols(self, name: str) -> list[str]:
        if self.suffix and name.endswith(self.suffix):
            body = name[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(name)

    def encode(self, word: str) -> list[int]:
        """The ids of a word of symbols."""
        symbols: list[str] | str = word
        if self.suffix:
            symbols = [*word[:-1], word[-1] + self.suffix]
        states, backs, labels = [self.start], [0], [0]
        arcs = self.arcs
        for stop in range(1, len(symbols) + 1):
            node, begin = arcs, stop
            while True:
                begin -= 1
                node = node[symbols[begin]]  # one of the arcs always fits, so this ends
                arc = node.get("")
                if arc and not bisect_right(states[begin], arc[0]) & 1:
                    break
            states.append(arc[1])
            backs.append(begin)
            labels.append(arc[2])
        ids, at = [], len(symbols)
        while at:
            ids.append(labels[at])
            at = backs[at]
        ids.reverse()
        return ids


class Tokenizer:
    """A file of the tokenizers library: its own normal form and word split, the automaton for the merges."""

    def __init__(self, path: str):
        with open(path, "rb") as source:
            self.text = source.read().decode()
        file = json.loads(self.text)
        model = file["model"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(option) for option in plain):
            raise ValueError("not a plain file of merges")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {u + v for u, v in merges}
        base = [name for name in model["vocab"] if name not in made]
        self.automaton = Automaton(base, merges, model["vocab"], model.get("end_of_word_suffix") or "")
        self.added = {token["content"]: token["id"] for token in file["added_tokens"]}
        self.labels = self.automaton.labels | {i: content for content, i in self.added.items()}
        self.byte_level = (file.get("decoder") or {}).get("type") == "ByteLevel"
        self.blanks = not self.byte_level
        self._library = None

    def __getstate__(self):
        return self.__dict__ | {"_library": None}

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_str(self.text)
        library = self._library
        normal = library.normalizer.normalize_str(text) if library.normalizer else text
        return [word for word, _ in library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_chunks(self, batch: Sequence) -> tuple[np.ndarray, np.ndarray]:
        encode = self.automaton.encode
        known: dict[str, list[int]] = {}
        found = []
        for chunk in batch:
            if isinstance(chunk, int):  # an added token
                found.append([chunk])
                continue
            ids: list[int] = []
            for word in self.words(chunk.decode() if self.blanks else byte_level_text(chunk)):
                if word not in known:
                    known[word] = encode(word)
                ids += known[word]
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def table(self, limit: int) -> ChunkTable:
        chunks = blank_chunks if self.blanks else byte_level_chunks
        return ChunkTable(self.encode_chunks, around_added(self.added, chunks), limit)

    def decode(self, ids: Sequence[int]) -> str:
        """The labels of the arcs: as bytes where the file says so, else with spaces between."""
        if self.byte_level:
            return _from_letters("".join(map(self.labels.__getitem__, ids)))
        return " ".join(map(self.labels.__getitem__, ids))


def _from_letters(text: str) -> str:
    from learnlens.llm.tokens import byte_letters

    back = {letter: byte for byte, letter in enumerate(byte_letters())}
    return bytes(b for c in text for b in ([back[c]] if c in back else c.encode())).decode("utf-8", "replace")


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
ROWS = 1000  # coded at once


def _coded(documents: DataFrame, path: str, schema: pa.Schema, ddl: str, row, limit: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(Tokenizer(path))  # follows the file alone

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        table = tokenizer.table(limit)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                names, texts = zip(*text_rows(iter([batch.slice(at, ROWS)]), "doc_id", "text"), strict=True)
                rows = [row(tokenizer, n, ids) for n, ids in zip(names, table.ids(texts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

    return documents.select("doc_id", "text").mapInArrow(code, ddl)


def encode(documents: DataFrame, scratch: Scratch, path: str, limit: int = 500_000) -> DataFrame:
    """``(doc_id, ids)`` of every text; ``limit``: distinct chunks a task remembers."""
    return _coded(documents, path, _IDS, "doc_id long, ids array<int>", lambda _, n, ids: (n, ids.tolist()), limit)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids decode to an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(Tokenizer(path))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(ids or []) for (ids,) in text_rows(iter([batch]), "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(spell, "doc_id long, text string")


def digests(documents: DataFrame, scratch: Scratch, path: str, limit: int = 500_000) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text."""

    def row(tokenizer: Tokenizer, doc_id, ids: np.ndarray):
        text = tokenizer.decode(ids.tolist())
        return (
            doc_id,
            len(ids),
            hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(documents, path, _DIGESTS, ddl, row, limit)
