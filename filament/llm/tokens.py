"""Texts as token ids of a public byte-level BPE tokenizer.

Pre-tokenisation runs over whole batches: every character becomes a symbol by its codepoint
class and the characters after it, every symbol is a transition function of the tokenizer's
splitting automaton, and an associative scan composes these functions, so that the state
before each character, and with it the boundaries, are found without going through the text
one character after another; no regular expression is run. The slices between boundaries go
through a cache of pair merges, which are made here by rank for all unknown slices of a
batch together; ids are gathered from the cache by index arithmetic.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters worked on at a time, and slices kept in a worker's cache.
BATCH_CHARS = 1 << 19
CACHE_SLICES = 400_000
CACHED_LENGTH = 48

_LETTER, _NUMBER, _OTHER, _SPACE, _BREAK, _EDGE = range(6)
#: Code points that are white space (the Unicode property).
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for name, kind in (("L", _LETTER), ("N", _NUMBER)):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            out[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
    out[_WHITE] = _BREAK
    out[32] = _SPACE
    return out


# States of the automaton: the class of the character before (0 to 5), or the place in a contraction.
_LAST, _ONE_MORE, _TWO_MORE = 6, 7, 8
_STATES = 9
# Symbols: letter, number, other; white space before other text, and not, for space and others; signs that open a contraction of two and three characters.
_SPACE_LAST, _SPACE_INSIDE, _BREAK_LAST, _BREAK_INSIDE, _SHORT, _LONG = 3, 4, 5, 6, 7, 8
_SYMBOLS = 9


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice begins), by symbol and state. Symbols from _SYMBOLS on are the same at the beginning of a text, where the state does not count.

    Slices are: a contraction ('s 't 'm 'd 're 've 'll); letters, numbers or other signs,
    each with one space before; white space up to the last character before other text;
    white space at the end of a text.
    """
    after, cut = np.zeros((2 * _SYMBOLS, _STATES), np.uint8), np.zeros((2 * _SYMBOLS, _STATES), bool)
    for symbol in range(_SYMBOLS):
        for state in range(_STATES):
            contracts = symbol in (_SHORT, _LONG) and state not in (_OTHER, _SPACE)
            if state in (_ONE_MORE, _TWO_MORE):
                step = (state - 1, False)
            elif contracts:
                step = (_ONE_MORE if symbol == _SHORT else _TWO_MORE, True)
            elif symbol in (_LETTER, _NUMBER, _OTHER, _SHORT, _LONG):
                kind = symbol if symbol <= _OTHER else _OTHER
                step = (kind, state not in (kind, _SPACE))
            else:
                kind = _SPACE if symbol in (_SPACE_LAST, _SPACE_INSIDE) else _BREAK
                step = (kind, state not in (_SPACE, _BREAK) or symbol in (_SPACE_LAST, _BREAK_LAST))
            after[symbol, state], cut[symbol, state] = step
        after[_SYMBOLS + symbol], cut[_SYMBOLS + symbol] = after[symbol, _EDGE], cut[symbol, _EDGE]
    return after, cut


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; starts: places at which a text begins."""
    n = len(points)
    kind = char_classes()[points]
    after = np.full(n + 2, _EDGE, np.uint8)  # class of the next character of the same text
    after[:n - 1] = kind[1:]
    after[starts[starts > 0] - 1] = _EDGE
    out = np.where(kind < _SPACE, kind, np.where(kind == _SPACE, _SPACE_LAST, _BREAK_LAST) + (after[:n] >= _SPACE)).astype(np.uint8)
    at = np.flatnonzero(points == 39)
    if len(at):
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = np.where(after[at] == _EDGE, 0, pad[at + 1]), pad[at + 2]
        b = np.where((after[at] == _EDGE) | (after[at + 1] == _EDGE), 0, b)
        out[at[np.isin(a, (115, 116, 109, 100))]] = _SHORT
        out[at[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]] = _LONG
    out[starts] += _SYMBOLS
    return out


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each code point; starts: places at which a text begins, the first one 0.

    Transition functions compose, so they are scanned as any associative operation: the
    characters are cut into blocks, within all blocks at once the functions of the first,
    the first two … characters are composed, then those of whole blocks by doubling. A
    block's entry state picks the state before each of its characters.
    """
    step, cut = automaton()
    n = len(points)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    of = np.zeros(blocks * width, np.uint16)
    of[:n] = symbols(points, starts)
    table, base = step.ravel(), np.ascontiguousarray((of * np.uint16(_STATES)).reshape(blocks, width).T)
    composed = np.empty((width + 1, blocks, _STATES), np.uint8)
    composed[0] = np.arange(_STATES, dtype=np.uint8)
    for j in range(width):
        np.take(table, base[j][:, None] + composed[j], out=composed[j + 1], mode="clip")
    whole, reach = composed[width].copy(), 1
    while reach < blocks:  # whole[b] becomes the function of all characters up to the end of block b
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], 1)
        reach *= 2
    entry = np.append(_EDGE, whole[:-1, _EDGE])
    before = np.take_along_axis(composed[:width], np.broadcast_to(entry[None, :, None], (width, blocks, 1)).astype(np.intp), 2)[:, :, 0]
    return cut.ravel()[(base + before).T.ravel()[:n]]


class Merges:
    """Merging of byte pairs: of a slice's neighbouring tokens the pair that makes the token of least rank is joined, the first of equal ones, until none makes a token."""

    #: Bytes up to which slices are merged together, a row each.
    TOGETHER = 48

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        get = ranks.get
        pairs = {(get(t[:i], -1) << 20) | get(t[i:], -1): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self._keys = np.array(sorted(pairs), np.int64)
        self._made = np.array([pairs[k] for k in self._keys.tolist()], np.int32)
        self._pairs = pairs

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token that each pair makes, or the largest number for none; so for padding, which is negative."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (right >= 0), self._made[at], _NONE)

    def many(self, slices: list[bytes]) -> list[np.ndarray | list[int]]:
        """Tokens of each slice; a slice that is a token is that one."""
        out: list = [[r] if (r := self.ranks.get(s)) is not None else None for s in slices]
        rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(slices[i]))
        lengths = np.array([len(slices[i]) for i in rest])
        begin = 0
        while begin < len(rest):
            width = lengths[begin]
            if width > self.TOGETHER:
                for i in rest[begin:]:
                    out[i] = self.one(slices[i])
                break
            stop = int(np.searchsorted(lengths, width + width // 4, side="right"))
            stop = min(stop, begin + 20_000)
            rows = [slices[i] for i in rest[begin:stop]]
            for i, tokens in zip(rest[begin:stop], self._rows(rows), strict=True):
                out[i] = tokens
            begin = stop
        return out

    def _rows(self, slices: list[bytes]) -> list[np.ndarray]:
        n = np.fromiter(map(len, slices), np.int64, len(slices))
        width = int(n.max()) + 1  # a column of padding, so that shifting has something to take
        tokens = np.full((len(slices), width), -1, np.int32)
        tokens[np.arange(width) < n[:, None]] = self.bytes[np.frombuffer(b"".join(slices), np.uint8)]
        made = np.full((len(slices), width), _NONE, np.int32)
        made[:, :-1] = self._rank(tokens[:, :-1], tokens[:, 1:])
        active, place = np.arange(len(slices)), np.arange(width)
        while len(active):
            best = made[active].argmin(1)
            least = made[active, best]
            going = least < _NONE
            active, best, least = active[going], best[going], least[going]
            if not len(active):
                break
            take = np.minimum(place + (place > best[:, None]), width - 1)
            t, m = np.take_along_axis(tokens[active], take, 1), np.take_along_axis(made[active], take, 1)
            r = np.arange(len(active))
            t[r, best] = least
            m[r, best] = self._rank(least, t[r, np.minimum(best + 1, width - 1)])
            inner = np.flatnonzero(best > 0)
            m[inner, best[inner] - 1] = self._rank(t[inner, best[inner] - 1], least[inner])
            tokens[active], made[active] = t, m
            n[active] -= 1
        return [row[:k] for row, k in zip(tokens, n.tolist(), strict=True)]

    def one(self, data: bytes) -> list[int]:
        """Tokens of a long slice, by a heap of its pairs."""
        tokens = self.bytes[np.frombuffer(data, np.uint8)].tolist()
        n, get = len(tokens), self._pairs.get
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := get(tokens[i] << 20 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = following[i]
            if j >= n or tokens[i] != a or tokens[j] != b:
                continue  # one of the two was joined with another before
            tokens[i], tokens[j] = r, -1
            following[i] = k = following[j]
            if k < n:
                preceding[k] = i
                if (made := get(r << 20 | tokens[k])) is not None:
                    heapq.heappush(heap, (made, i, r, tokens[k]))
            if (h := preceding[i]) >= 0 and (made := get(tokens[h] << 20 | r)) is not None:
                heapq.heappush(heap, (made, h, tokens[h], r))
        return [x for x in tokens if x >= 0]


_NONE = np.int32(2**31 - 1)


class Encoder:
    """Encodes batches of texts; one a worker process and vocabulary."""

    def __init__(self, folder: str, vocabulary: str) -> None:
        with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._merges = Merges(ranks)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._bytes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self._bytes[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self._reset()

    def _reset(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.int32)
        self._first = np.zeros(1 << 12, np.int64)
        self._n_ids = 0

    def _learn(self, slices: Iterable[str]) -> None:
        """Put unknown slices into the cache."""
        new = {s: None for s in slices}
        many = self._merges.many([s.encode("utf-8", "surrogatepass") for s in new])
        lengths = np.fromiter(map(len, many), np.int64, len(many))
        flat = np.fromiter(chain.from_iterable(many), np.int32, int(lengths.sum()))
        at = len(self._known)
        while len(self._ids) < self._n_ids + len(flat):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while len(self._first) < at + len(many) + 1:
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
        self._ids[self._n_ids : self._n_ids + len(flat)] = flat
        self._first[at + 1 : at + len(many) + 1] = self._n_ids + np.cumsum(lengths)
        self._n_ids += len(flat)
        self._known.update(zip(new, range(at, at + len(new)), strict=True))

    def encode(self, texts: list[str], offsets: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ids of all texts in one array, where each text's ids begin (one more entry at the end), and each id's first character.

        The characters count from the beginning of the joined texts; an id that begins within
        a character has that one. They are None without offsets.
        """
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths) - lengths
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64) if offsets else None
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero(boundaries(points, begin[lengths > 0]))
        ends = np.append(starts[1:], len(points))
        slices = list(map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist())))
        if len(self._known) > CACHE_SLICES:
            self._reset()
        get = self._known.get
        codes = np.fromiter((get(s, -1) for s in slices), np.int64, len(slices))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            self._learn(slices[i] for i in missing)
            codes[missing] = np.fromiter((self._known[slices[i]] for i in missing), np.int64, len(missing))
        first, count = self._first[codes], self._first[codes + 1] - self._first[codes]
        upto = np.cumsum(count)
        ids = self._ids[np.repeat(first - (upto - count), count) + np.arange(upto[-1])]
        where = np.searchsorted(starts, np.append(begin, len(points)))
        tokens_before = np.append(0, upto)
        self._forget(slices, missing)
        return ids, tokens_before[where], self._characters(points, ids) if offsets else None

    def _characters(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The character in which each id's bytes begin."""
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        length = self._bytes[ids]
        return np.searchsorted(np.cumsum(width) - width, np.cumsum(length) - length, side="right") - 1

    def _forget(self, slices: list[str], missing: np.ndarray) -> None:
        """Long slices are no words and do not come again: they leave the cache with the next reset."""
        if any(len(slices[i]) > CACHED_LENGTH for i in missing) and self._n_ids > 8 * CACHE_SLICES:
            self._reset()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


@functools.cache
def encoder(folder: str, vocabulary: str) -> Encoder:
    return Encoder(folder, vocabulary)


def _cuts(text: str) -> list[str]:
    """A very long text in parts, cut before a single space between letters, where a slice begins anyway."""
    parts, at = [], 0
    while len(text) - at > BATCH_CHARS:
        stop = at + BATCH_CHARS
        while True:
            stop = text.find(" ", stop)
            if stop < 0:
                return [*parts, text[at:]]
            if text[stop - 1].isalpha() and text[stop + 1 : stop + 2].isalpha():
                break
            stop += 1
        parts.append(text[at:stop])
        at = stop
    return [*parts, text[at:]]


def encode_batches(texts: list[str], enc: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, ids, first id of each text) of consecutive texts, a bounded number of characters at a time."""
    return (x[:3] for x in batches_with_offsets(texts, enc, False))


def batches_with_offsets(texts: list[str], enc: Encoder, offsets: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """encode_batches() with each id's first character, from the beginning of its text; None without offsets."""
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (chars + len(texts[stop]) <= BATCH_CHARS or stop == at):
            chars += len(texts[stop])
            stop += 1
        if chars > BATCH_CHARS:  # one very long text
            begin, many, characters = 0, [], []
            for part in _cuts(texts[at]):
                ids, _, where = enc.encode([part], offsets)
                many.append(ids)
                if offsets:
                    characters.append(begin + where)
                begin += len(part)
            ids = np.concatenate(many)
            yield 1, ids, np.array([0, len(ids)]), np.concatenate(characters) if offsets else None
        else:
            ids, first, where = enc.encode(texts[at:stop], offsets)
            if offsets:
                lengths = np.fromiter(map(len, texts[at:stop]), np.int64, stop - at)
                where = where - np.repeat(np.cumsum(lengths) - lengths, np.diff(first))
            yield stop - at, ids, first, where
        at = stop


def _texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a column; null is the empty text, bytes that are no UTF-8 become the replacement character."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def token_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, offsets: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; what spells one is ordinary text.

    offsets: name of a third column with the character (code point, from 0) of the text in
    which each id begins; ids that share a character have the same. Bytes that are no UTF-8
    count as the replacement characters they become.
    Null and empty texts have the empty list. Repeated rows stay. No rows are moved.
    """

    names = [key, "ids"] if offsets is None else [key, "ids", offsets]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            at = 0
            for n, ids, first, where in batches_with_offsets(_texts(batch.column(1)), enc, offsets is not None):
                begin = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(begin, pa.array(x)) for x in ([ids] if where is None else [ids, where.astype(np.int32)])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *lists], names=names)
                at += n

    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"`{x}` array<int>" for x in names[1:])])
    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(encode, schema)


def decode_ids(df: DataFrame, key: str, ids: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of each id list; the empty text of an empty or null list."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(decode, f"`{key}` {kind}, text string")
