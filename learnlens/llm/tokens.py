"""Token ids of whole texts, from the ids of their distinct chunks.

A tokenizer never merges across the chunks that its own pattern cuts, so a text's ids are the ids
of its chunks in a row.  Texts are cut into coarser chunks at places where the pattern must cut,
each distinct chunk goes through the tokenizer once per task, and the ids are gathered by
chunk number.  What a group of texts costs follows from its own chunks, not from the table's size.
When the table holds ``TABLE_LIMIT`` chunks only the half of them that is used most stays: memory
is bounded, and ids never depend on it.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from itertools import chain, compress, islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex

TABLE_LIMIT = 1_000_000
GROUP_BYTES = 8_000_000  # texts that are cut at once hold about as many
_NUMBER = attrgetter("id")  # of a token

# White space as Unicode defines it (White_Space); Python's own class knows four more.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Byte-level BPE: a word takes one space before it, other white space stays in runs of which
# the last character is left to what follows.
_WORDS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
_RARE_WHITE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

# Of the characters beyond ASCII, all but the letters of Latin-1.
_STRANGE = re.compile("[\x80-\xbf\xd7\xf7\u0100-\U0010ffff]")
# Bytes as marks (.), blanks (space) and word characters (a).
_KINDS = bytes(
    32 if i in b" \t\n\x0b\x0c\r" else 97 if chr(i).isalnum() or i > 127 else 46 for i in range(256)
)


def _lone_marks(text: str, data: bytes) -> bytes | None:
    """The kinds of the bytes, if no two marks are neighbours: then commas and full stops are
    words of their own."""
    if not text.isascii() and _STRANGE.search(text):
        return None
    kinds = data.translate(_KINDS)
    return None if b".." in kinds else kinds


def byte_level_marked(text: str) -> str | None:
    """The text with a space before each chunk.  A chunk stands for itself after a space or, with a
    zero before it, for itself alone.  None where white space is not so simple."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text or _RARE_WHITE.search(text):
        return None
    kinds = _lone_marks(text, text.encode())
    if kinds and kinds[:1] != b"." and b" ." not in kinds:  # marks follow words
        text = text.replace(".", " \0.").replace(",", " \0,")
    return "\0" + text.replace("\n", " \0\n \0")


def byte_level_chunks(text: str) -> list[str]:
    line = byte_level_marked(text)
    return ["\0" + piece for piece in _WORDS.findall(text)] if line is None else line.split(" ")


def byte_level_text(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == "\0" else " " + chunk


def blank_chunks(text: str) -> list[bytes]:
    """For tokenizers that drop case and white space: cut at ASCII blanks only, the rest is theirs."""
    data = text.encode()
    if _lone_marks(text, data):
        data = data.lower().replace(b".", b" .").replace(b",", b" ,")
    return data.split()


def around_added(added: dict[str, int], chunks: Callable[[str], list]) -> Callable[[str], list]:
    """``chunks`` of what lies between the strings of added tokens, and the ids of these.

    The library finds added tokens first, the longest at a place, and treats what is between them as
    texts of their own.
    """
    if not added:
        return chunks
    longest_first = sorted(added, key=len, reverse=True)
    found = re.compile(f"({'|'.join(map(re.escape, longest_first))})")

    def cut(text: str) -> list:
        if not found.search(text):
            return chunks(text)
        out: list = []
        for number, part in enumerate(found.split(text)):
            if number % 2:
                out.append(added[part])
            elif part:
                out += chunks(part)
        return out

    return cut


# Kinds of bytes: blanks, letters of ASCII and Latin-1, digits, marks, apostrophes, which may begin
# a piece of letters such as 's, and all others, next to which nothing is cut.
_BLANK, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(6)
_BLANKS = b" \t\n\x0b\x0c\r"


def _kind(byte: int) -> int:
    char = chr(byte)
    if byte in _BLANKS:
        return _BLANK
    if byte < 32 or byte > 126:
        return _OTHER
    if char.isalpha():
        return _LETTER
    return _DIGIT if char.isdigit() else _APOSTROPHE if char == "'" else _MARK


_ADDED = 0x10000  # what is added to an id to make it such a character
_BYTE_KINDS = bytes(map(_kind, range(256)))
# By 8 * the kind of a byte + the kind of the next: 1 where a chunk begins with the next, 2 where it is blank.
_NEXT = bytearray(256)
for _last, _begin in (
    (_BLANK, (_LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER)),
    (_LETTER, (_DIGIT, _MARK, _APOSTROPHE)),
    (_DIGIT, (_LETTER, _DIGIT, _MARK, _APOSTROPHE)),
    (_MARK, (_LETTER, _DIGIT)),
    (_APOSTROPHE, (_DIGIT,)),
    (_OTHER, ()),
):
    _NEXT[8 * _last + _BLANK] = 2
    for _own in _begin:
        _NEXT[8 * _last + _own] = 1
_NEXT = bytes(_NEXT)


def blank_words(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts cut all at once, for the same tokenizers as ``blank_chunks``: distinct chunks, the number
    of each chunk among them, and how many chunks each text has.

    Cut at ASCII blanks, and where pieces of letters, digits and marks must meet.  Small letters are
    the file's own, but no letter changes before a character that could join it in a normal form.
    """
    blob = b" " + b" ".join(texts)
    raw = np.frombuffer(blob, np.uint8)
    kinds = np.frombuffer(bytearray(blob).translate(_BYTE_KINDS), np.uint8)
    latin = np.flatnonzero(raw == 0xC3)  # leads U+00C0 to U+00FF: letters but for the signs of times and division
    latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
    kinds[latin] = kinds[latin + 1] = _LETTER
    small = np.frombuffer(bytearray(blob.lower()), np.uint8)
    strange = np.flatnonzero((raw >= 0xC2) & (raw != 0xC3)) - 1
    small[strange] = raw[strange]
    nexts = (8 * kinds[:-1] + kinds[1:]).tobytes().translate(_NEXT)
    places = np.flatnonzero(np.frombuffer(nexts, np.uint8) == 1) + 1
    solid = small.tobytes().translate(None, _BLANKS)
    offsets = np.flatnonzero(np.frombuffer(nexts.translate(None, b"\2"), np.uint8))
    offsets = np.append(offsets, len(solid)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    coded = chunks.dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    stops = np.cumsum([len(text) + 1 for text in texts])
    return words, coded.indices.to_numpy(), np.diff(np.searchsorted(places, stops), prepend=0)


def added_words(added: dict[str, int]) -> Callable[[str], bytes]:
    """Texts for ``blank_words``: a string of an added token becomes a chunk that no text has: 0xFF, and the id
    as a character that no cut goes through."""
    longest_first = sorted((token.encode() for token in added), key=len, reverse=True)
    found = re.compile(b"|".join(map(re.escape, longest_first)))
    marked = {token.encode(): b" \xff" + chr(_ADDED + i).encode() + b" " for token, i in added.items()}

    def mark(text: str) -> bytes:
        data = text.encode()
        return found.sub(lambda m: marked[m.group()], data) if added else data

    return mark


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``begin``, ``begin + 1`` and so on, as many as ``sizes`` says, one after the other."""
    stops = np.cumsum(sizes, dtype=begin.dtype)
    return np.arange(stops[-1] if len(stops) else 0, dtype=begin.dtype) + np.repeat(begin - stops + sizes, sizes)


class ChunkTable:
    """Ids of texts, in a task.

    ``chunks`` cuts a text; ``encode`` gives how many ids each of a list of chunks has, and all ids
    in a row.  With ``words`` texts are cut many at a time: it gives the bytes that ``blank_words`` cuts.
    """

    def __init__(
        self,
        encode: Callable[[Sequence], tuple[np.ndarray, np.ndarray]],
        chunks: Callable[[str], list] | None,
        limit: int = TABLE_LIMIT,
        words: Callable[[str], bytes] | None = None,
    ):
        self.encode, self.chunks, self.limit, self.words = encode, chunks, limit, words
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.used, self.coded = 0, 0

    def _keep(self, most: int) -> None:
        """Keep the ``most`` chunks that are used most, at half their uses so that new ones can pass them.

        Rare chunks, which would be tokenized anew anyway, make room; common ones are not tokenized again.
        """
        uses = self.uses[: self.coded]
        kept = np.sort(np.argpartition(-uses, most - 1)[:most]) if most else np.empty(0, np.int64)
        stays = np.zeros(self.coded, bool)
        stays[kept] = True
        chunks = list(compress(self.numbers, stays.tolist()))
        sizes = np.diff(self.starts[: self.coded + 1])
        flat = self.flat[: self.used][np.repeat(stays, sizes)]
        self.clear()
        self.numbers.update(zip(chunks, range(len(chunks)), strict=True))
        self._append(sizes[kept], flat)
        self.uses[: self.coded] = uses[kept] // 2

    def _append(self, sizes: np.ndarray, new: np.ndarray) -> None:
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.coded + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.flat[self.used : self.used + len(new)] = new
        self.starts[self.coded + 1 : self.coded + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(new)
        self.coded += len(sizes)

    def _code_fresh(self) -> None:
        # from the end, where the fresh ones are: a walk from the start passes the whole table
        fresh = list(islice(reversed(self.numbers), len(self.numbers) - self.coded))[::-1]
        for at in range(0, len(fresh), 10_000):
            self._append(*self.encode(fresh[at : at + 10_000]))

    def ids(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Token ids of each text as uint32; a null text is an empty one."""
        out: list[np.ndarray] = []
        if self.words:
            group: list[bytes] = []
            held = 0
            for text in texts:
                group.append(self.words(text) if text else b"")
                held += len(group[-1])
                if held > GROUP_BYTES:
                    out.extend(self._worded(group))
                    group, held = [], 0
            out.extend(self._worded(group))
            return out
        codes: list[np.ndarray] = []
        held = 0
        for text in texts:
            chunks = self.chunks(text) if text else []
            codes.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks)))
            held += len(chunks)
            if held > 50_000:  # what is not coded yet comes on top of the table
                out.extend(self._gathered(codes))
                codes, held = [], 0
        out.extend(self._gathered(codes))
        return out

    def _gathered(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        if not codes:
            return []
        self._code_fresh()
        code = np.concatenate(codes)
        np.add.at(self.uses, code, 1)  # a bincount is as long as the table
        begin = self.starts[code]
        sizes = self.starts[code + 1] - begin
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ends = stops[np.cumsum([len(c) for c in codes])]
        parts = np.split(self.flat[_places(begin, sizes)], ends[:-1])
        self._bound()
        return parts

    def _worded(self, texts: list[bytes]) -> list[np.ndarray]:
        """As ``_gathered``; the table is asked once for each distinct chunk of the texts."""
        if not texts:
            return []
        words, local, counts = blank_words(texts)
        code = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._code_fresh()
        self.uses[code] += np.bincount(local, minlength=len(words))
        begin = self.starts[code]
        sizes = (self.starts[code + 1] - begin).astype(np.int32)
        flat = self.flat[_places(begin, sizes)]
        begin = np.cumsum(sizes, dtype=np.int32) - sizes
        sizes = sizes[local]
        stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        parts = np.split(flat[_places(begin[local], sizes)], stops[np.cumsum(counts)][:-1])
        self._bound()
        return parts

    def _bound(self) -> None:
        if len(self.numbers) > self.limit:
            self._keep(self.limit // 2)


# How files that drop white space split text before their merges.  Fixed value.
_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Printable Latin-1 without white space but a first space: what no normal form changes, and
# lower() maps one by one.
_PLAIN = regex.compile(" ?[!-~\xa1-\xac\xae-\xff]+")
# A word that every byte-level pattern leaves whole: letters of ASCII and Latin-1.
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies have for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


class _Words:
    """Ids of chunks.  Words of letters go straight to the file's merges, other plain chunks through
    the tokenizer in bulk, the rest through it one by one.

    ``as_text``: strings of added tokens are ordinary text.  Else they are these tokens, as the
    library has it by default, and ``added`` has them: they come as ids in place of chunks, or as
    ``added_words`` marks them.
    """

    def __init__(self, path: str, kind: str, as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        tokens = self.tokenizer.get_added_tokens_decoder()
        self.added = {} if as_text else {token.content: i for i, token in tokens.items()}
        if not as_text and any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokens.values()):
            raise ValueError("added tokens that look at what is around them are not supported")
        self.split = regex.compile(_MARKS).findall
        self.blanks = kind == "blanks"
        self.plain = self._merged if self.blanks else self._lines
        self.letters = byte_letters()
        self.spelled = {i: "".join([self.letters[b] for b in chr(i).encode()]) for i in range(128, 256)}
        # an added token, or a normal form, could make something else of a word of letters
        added = [token.content.strip() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.straight = (
            kind == "byte_level"
            and self.tokenizer.normalizer is None
            and not any(_LETTERS.fullmatch(content) for content in added)
        )
        newline = self._whole(["\n"])[0]
        self.newline = newline[0] if len(newline) == 1 else None

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [one.ids for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, texts: list[str]) -> list[list[int]]:
        """Word by word, in small letters."""
        split, merge, letters = self.split, self.tokenizer.model.tokenize, self.letters
        out = []
        for text in texts:
            ids: list[int] = []
            for word in split(text.lower()):
                if not word.isascii():  # printable ASCII stands for itself
                    word = "".join([letters[b] for b in word.encode()])
                ids += [token.id for token in merge(word)]
            out.append(ids)
        return out

    def _lines(self, texts: list[str]) -> list[list[int]]:
        """As lines of one text: a chunk holds no line break, and none joins its neighbours."""
        if self.newline is None:
            return self._whole(texts)
        groups = ["\n".join(texts[i : i + 200]) for i in range(0, len(texts), 200)]
        out: list[list[int]] = []
        for one in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
            ids = one.ids
            at = 0
            for _ in range(ids.count(self.newline)):
                stop = ids.index(self.newline, at)
                out.append(ids[at:stop])
                at = stop + 1
            out.append(ids[at:])
        return out

    def _words(self, batch: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Byte-level chunks: a word of letters is one piece of the pattern, so its ids are its merges."""
        merge, spelled, space = self.tokenizer.model.tokenize, self.spelled, self.letters[32]
        ids: list[list[int] | None] = []
        others: list[int] = []
        for i, chunk in enumerate(batch):
            word = chunk[1:] if chunk[:1] == "\0" else chunk
            if not _LETTERS.fullmatch(word):
                others.append(i)
                ids.append(None)
                continue
            if not word.isascii():
                word = word.translate(spelled)
            ids.append(list(map(_NUMBER, merge(word if chunk[:1] == "\0" else space + word))))
        for i, own in zip(others, self._mixed([byte_level_text(batch[i]) for i in others]), strict=True):
            ids[i] = own
        return self._flat(ids)

    def __call__(self, batch: Sequence) -> tuple[np.ndarray, np.ndarray]:
        if self.added and any(isinstance(chunk, int) for chunk in batch):
            own = {i: chunk for i, chunk in enumerate(batch) if isinstance(chunk, int)}
            sizes, flat = self([chunk for chunk in batch if not isinstance(chunk, int)])
            rest = iter(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])
            return self._flat([[own[i]] if i in own else next(rest).tolist() for i in range(len(batch))])
        if self.straight:
            return self._words(batch)
        if self.blanks:
            return self._small_words(batch)
        return self._flat(self._mixed(list(map(byte_level_text, batch))))

    def _small_words(self, batch: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks between blanks: a word of letters is one piece, so its ids are its merges."""
        merge, spelled = self.tokenizer.model.tokenize, self.spelled
        ids: list[list[int] | None] = []
        others: list[int] = []
        for i, chunk in enumerate(batch):
            if chunk[:1] == b"\xff":  # an added token
                ids.append([ord(chunk[1:].decode()) - _ADDED])
                continue
            word = chunk.decode().lower()
            if not chunk.isalpha():
                if not _LETTERS.fullmatch(chunk.decode()):
                    others.append(i)
                    ids.append(None)
                    continue
                word = word.translate(spelled)
            ids.append(list(map(_NUMBER, merge(word))))
        for i, own in zip(others, self._mixed([batch[i].decode() for i in others]), strict=True):
            ids[i] = own
        return self._flat(ids)

    def _mixed(self, texts: list[str]) -> list[list[int]]:
        easy = [_PLAIN.fullmatch(t) is not None for t in texts]
        plain = iter(self.plain([t for t, e in zip(texts, easy, strict=True) if e]))
        others = iter(self._whole([t for t, e in zip(texts, easy, strict=True) if not e]))
        return [next(plain) if e else next(others) for e in easy]

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))


_TABLES: dict[tuple, ChunkTable] = {}


def hugging_table(path: str, kind: str, as_text: bool = False, limit: int = TABLE_LIMIT) -> ChunkTable:
    """The chunk table of a ``tokenizers`` file, one in each Python worker.

    ``kind``: ``byte_level`` or ``blanks``, how the file's own pattern treats white space.  No
    special tokens are added.  Their strings in a text are these tokens, as the library has it, or
    with ``as_text`` ordinary text.
    """
    key = (path, as_text, limit)
    if key not in _TABLES:
        words = _Words(path, kind, as_text)
        if kind == "blanks":
            _TABLES[key] = ChunkTable(words, None, limit, added_words(words.added))
        else:
            _TABLES[key] = ChunkTable(words, around_added(words.added, byte_level_chunks), limit)
    return _TABLES[key]
