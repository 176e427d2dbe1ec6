"""Byte-pair encoding as vectorised merge rounds over flat numpy arrays.

A chunk of texts is one array of code points. Texts fall into words that no merge can cross;
equal words are merged once: a hash finds them, and their code points are compared before one
stands for the other. The symbols of all new words lie in one flat array. A round takes, in every
word, the pair of lowest rank (segmented minimum), merges its places in all words at once, compacts
the array, and looks up only the pairs that changed; words without a pair left leave the array.

The order of the sequential algorithm is kept exactly. A word's places of lowest rank merge together
as far as the merged pieces have no pair of that rank or a lower one, else up to the first that has;
that also holds for vocabularies in which a longer piece outranks its parts. A place deep in a long
word merges early where its rank is the least among all places that any piece could join it to
before (_early), so the rounds of a word don't grow with its length.

Texts with a character outside SAFE are encoded by the library itself (tokenizers files only):
its tables of letters and lower case may differ from Python's there.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

#: Characters of a chunk; one longer text is a chunk of its own.
CHUNK = 1 << 20
#: Words kept between chunks; beyond this the cache starts anew.
CACHE = 700_000
#: Characters and ids of words kept between chunks.
LETTERS = 1 << 24

_NONE = np.int32(2**31 - 1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))

LETTER, NUMBER, SPACE, OTHER, END = range(5)


class Pairs:
    """(left, right) -> rank and merged id: open addressing, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.rank, self.merged = rank.astype(np.int32), merged.astype(np.int32)
        # the lowest rank of a pair that a piece is in
        self.low = np.full(int(max(a.max(initial=0) for a in (left, right, merged))) + 1, _NONE)
        for side in (left, right):
            np.minimum.at(self.low, side, self.rank)
        keys, todo = self._key(left, right), np.arange(len(left))
        at = self._home(keys)
        while len(todo):
            free = self.keys[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.slot[at[put]] = keys[todo[put]], todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _R) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, or -1. A negative id is in no pair."""
        keys = self._key(left, right)
        keys[(left < 0) | (right < 0)] = -2
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.slot[at], np.int32(-1))
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.slot[at[hit]]
            go = ~hit & (seen != -1)
            todo, at = todo[go], at[go]
        return out


def _early(rank: np.ndarray, far: int) -> np.ndarray:
    """Places whose rank is below all of the far places before them, and above none of the far places behind.

    No piece is longer than reach symbols, and far is 2 * reach + 2. What merges further away can
    reach in by reach at most, and the place's own merges reach out by as much, so neither meets the
    other, and in between nothing goes before the place. Merging it now changes nothing.
    """
    least = np.concatenate([np.full(far, _NONE), rank, np.full(far + 1, _NONE)])
    width = 1
    while width * 2 <= far:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < far:
        least = np.minimum(least[: -(far - width)], least[far - width :])
    # least[k] is the minimum of far places from k on, where place 0 of the word is at far
    n = len(rank)
    return np.flatnonzero((rank < least[:n]) & (rank <= least[far + 1 : far + 1 + n]) & (rank != _NONE))


def _lowest(pairs: Pairs, word: np.ndarray, rank: np.ndarray, index: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of each word's lowest rank that merge in one round; low is the rank for each place."""
    at = np.flatnonzero(rank == low)
    place = np.arange(len(at))
    own = word[at]
    first = np.r_[True, own[1:] != own[:-1]]
    run = first | np.r_[True, at[1:] != at[:-1] + 1]
    at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]  # of overlapping pairs the left one
    own = word[at]
    first = np.r_[True, own[1:] != own[:-1]]
    ends = pairs.low[pairs.merged[index[at]]] <= rank[at]
    if not ends.any():
        return at
    before = np.cumsum(ends) - ends
    return at[before == before[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]


def merge_rounds(pairs: Pairs, symbols: np.ndarray, lens: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word of a flat symbol array to its end. lens >= 1; no piece has over reach symbols."""
    n, far = len(lens), 2 * reach + 2
    out_len = np.zeros(n, np.int64)
    done_sym: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    word = np.repeat(np.arange(n, dtype=np.int32), lens)
    sym = symbols.astype(np.int32)
    rank = np.full(len(sym), _NONE, np.int32)
    index = np.full(len(sym), -1, np.int32)

    def look(at: np.ndarray) -> None:
        at = at[(at >= 0) & (at + 1 < len(sym))]
        inside = word[at] == word[at + 1]
        rank[at[~inside]] = _NONE
        at = at[inside]
        found = pairs.find(sym[at], sym[at + 1])
        index[at] = found
        rank[at] = np.where(found >= 0, pairs.rank[found], _NONE)

    if len(sym):
        look(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[starts, len(sym)])
        low = np.minimum.reduceat(rank, starts)
        ended = low == _NONE
        if ended.any():
            gone = np.repeat(ended, size)
            done_sym.append(sym[gone])
            done_word.append(word[gone])
            keep = ~gone
            sym, word, rank, index = sym[keep], word[keep], rank[keep], index[keep]
            if not len(sym):
                break
            size, low = size[~ended], low[~ended]
        at = _lowest(pairs, word, rank, index, np.repeat(low, size))
        if (long := size > far).any():  # a shorter word lies in the reach of its lowest rank
            inside = np.flatnonzero(np.repeat(long, size))
            if len(early := _early(rank[inside], far)):
                chosen = np.zeros(len(sym), bool)
                chosen[at] = chosen[inside[early]] = True
                at = np.flatnonzero(chosen)
        sym[at] = pairs.merged[index[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        # the merged symbol is the last of its word when the removed one was
        at = at - np.arange(len(at))
        sym, word, rank, index = sym[keep], word[keep], rank[keep], index[keep]
        rank[at] = _NONE
        look(np.concatenate([at, at - 1]))
    if not done_sym:
        return np.zeros(0, np.int32), out_len
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n)


@functools.cache
def _mix() -> np.ndarray:
    x = np.arange(0x110000, dtype=np.uint64) + _R
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_R, _R_INV):
        a = np.full(1 << bits, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def span_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's content, wherever it lies. Spans of one hash may differ."""
    power, inverse = _powers(max(20, int(len(cps) + 1).bit_length()))
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(_mix()[cps] * power[: len(cps)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, safety and lower case of each code point. Safe: Latin and general punctuation."""
    kind = np.full(0x110000, OTHER, np.uint8)
    safe = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in (*range(0x2B0), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC, 0x2122):
        safe[c] = c != 0x130
        cat = unicodedata.category(chr(c))
        kind[c] = {"L": LETTER, "N": NUMBER}.get(cat[0], OTHER)
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    kind[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE
    return kind, safe, lower


class Flat:
    """A chunk of texts as one array of code points, with an end mark after each text."""

    def __init__(self, texts: Sequence[str]):
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.joined = "\n".join(texts) + "\n"
        self.cps = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        self.ends = np.cumsum(self.lens + 1) - 1
        self.starts = self.ends - self.lens


def _contraction(cps: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters that belong to an apostrophe at each place: 0, 1 or 2."""
    a = np.where(kind[at + 1] == LETTER, cps[at + 1], 0)
    b = np.where((a > 0) & (kind[np.minimum(at + 2, len(cps) - 1)] == LETTER), cps[np.minimum(at + 2, len(cps) - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    return np.where(one, 1, np.where(two, 2, 0))


def _runs(flat: Flat, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _classes()[0][cps]
    kind[flat.ends] = END
    return kind, np.r_[True, kind[1:] != kind[:-1]]


def split_bytes(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of byte-level words: a space joins the run after it; contractions part."""
    cps = flat.cps
    kind, first = _runs(flat, cps)
    run = np.flatnonzero(first)
    begin = first.copy()
    word = run[(kind[run] != SPACE) & (kind[run] != END) & (run > 0)]
    after = word[kind[word - 1] == SPACE]
    begin[after - 1] = True
    begin[after[cps[after - 1] == 32]] = False
    quote = np.flatnonzero((cps == 39) & first)
    quote = quote[(quote + 1 < len(cps)) & ((quote == 0) | (cps[quote - 1] != 32) | (kind[quote - 1] == END))]
    k = _contraction(cps, kind, quote)
    quote, k = quote[k > 0], k[k > 0]
    begin[quote + 1] = False
    begin[quote + k + 1] = True
    begin[flat.ends] = True
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], len(cps)]
    keep = kind[start] != END
    return start[keep], end[keep]


def split_words(flat: Flat, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words of a lower-casing file: letter runs, single digits, other runs."""
    kind, first = _runs(flat, cps)
    begin = first | (kind == NUMBER)
    quote = np.flatnonzero((cps == 39) & first)
    quote = quote[quote + 1 < len(cps)]
    k = _contraction(cps, kind, quote)
    quote, k = quote[k > 0], k[k > 0]
    begin[quote + 1] = False
    begin[quote + k + 1] = True
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], len(cps)]
    keep = kind[start] < SPACE
    keep |= kind[start] == OTHER
    return start[keep], end[keep]


class Known:
    """Word hashes seen, and a number of each: open addressing in two arrays, probed for whole arrays.

    Python's own dictionary would take five times the memory for each worker."""

    def __init__(self, capacity: int):
        self.bits = (capacity * 3 // 2).bit_length()
        self.mask = (1 << self.bits) - 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _R) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        todo, at = np.arange(len(hashes)), self._home(hashes)
        while len(todo):
            got = self.number[at]
            hit = (self.keys[at] == hashes[todo]) & (got >= 0)
            out[todo[hit]] = got[hit]
            go = ~hit & (got >= 0)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def add(self, hashes: np.ndarray, number: np.ndarray) -> None:
        """Number distinct hashes that aren't there yet."""
        todo, at = np.arange(len(hashes)), self._home(hashes)
        while len(todo):
            free = np.flatnonzero(self.number[at] < 0)
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]], self.number[at[put]] = hashes[todo[put]], number[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask


class Store:
    """Arrays of various lengths, one after the other in a flat one that grows."""

    def __init__(self, kind: type):
        self.flat = np.zeros(1 << 16, kind)
        self.at = np.zeros(1 << 12, np.int64)
        self.len = np.zeros(1 << 12, np.int64)
        self.used = self.size = 0

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.size + len(lens) > len(self.at):
            self.at, self.len = (np.concatenate([a, np.zeros_like(a)]) for a in (self.at, self.len))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[self.size : self.size + len(lens)] = self.used + np.cumsum(lens) - lens
        self.len[self.size : self.size + len(lens)] = lens
        self.used += len(flat)
        self.size += len(lens)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers, joined, and their lengths."""
        return spans(self.flat, self.at[which], self.len[which]), self.len[which]


def spans(flat: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Spans of a flat array, joined."""
    ends = np.cumsum(lens)
    return flat[np.repeat(start - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


def unequal(a: np.ndarray, a_start: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Which spans of a differ from their spans of b."""
    out = a_len != b_len
    same = np.flatnonzero(~out & ((a_start != b_start) | (a is not b)))
    lens = a_len[same]
    if not len(same):
        return out
    # places fit 32 bits: a chunk and the letters kept are far smaller, but for a text of 2 ** 31 characters
    kind = np.int32 if max(len(a), len(b)) < 1 << 31 else np.int64
    ends = np.cumsum(lens)
    place = np.repeat((a_start[same] - (ends - lens)).astype(kind), lens)
    place += np.arange(len(place), dtype=kind)
    left = a.take(place)
    place += np.repeat((b_start[same] - a_start[same]).astype(kind), lens)
    differ = np.flatnonzero(left != b.take(place))
    out[same[np.searchsorted(ends, differ, side="right")]] = True
    return out


class Encoder:
    """Turns lists of texts into flat ids; subclasses split texts and give words' symbols."""

    pairs: Pairs
    #: Symbols of the longest piece.
    reach: int

    def __init__(self) -> None:
        self._forget()

    def _forget(self, words: int = 0) -> None:
        self.known = Known(max(CACHE, words))
        self.ids = Store(np.uint32)
        self.letters = Store(np.uint32)
        #: Words that differ from another one of their hash.
        self.other: dict[str, int] = {}

    def _split(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, and where words start and end in them."""
        raise NotImplementedError

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _finish(self, sym: np.ndarray, lens: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return sym, lens

    def _library(self, text: str) -> list[int] | None:
        return None

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encode words; the numbers by which their ids are kept."""
        sym, lens = merge_rounds(self.pairs, *self._symbols(words), self.reach)
        self.ids.add(*self._finish(sym, lens, words))
        self.letters.add(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words)))
        return np.arange(self.ids.size - len(words), self.ids.size, dtype=np.int32)

    def _numbers(self, flat: Flat, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word. Words of one hash are compared with the one that it names."""
        lens = end - start
        codes, unique = pd.factorize(span_hashes(cps, start, end))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
        if self.ids.size + len(unique) > CACHE or max(self.ids.used, self.letters.used) > LETTERS:
            self._forget(len(unique))
        number = self.known.find(unique)
        wrong = np.zeros(len(unique), bool)
        old, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        of = number[old]
        wrong[old] = unequal(cps, start[first[old]], lens[first[old]], self.letters.flat, self.letters.at[of], self.letters.len[of])
        if len(new):
            number[new] = self._learn([flat.joined[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            self.known.add(unique[new], number[new])
        same = first[codes]
        odd = np.flatnonzero(wrong[codes] | unequal(cps, start, lens, cps, start[same], lens[same]))
        out = number[codes]
        if len(odd):
            words = [flat.joined[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True)]
            if fresh := list(dict.fromkeys(w for w in words if w not in self.other)):
                self.other.update(zip(fresh, self._learn(fresh).tolist(), strict=True))
            out[odd] = [self.other[w] for w in words]
        return out

    def _chunk(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = Flat(texts)
        cps, start, end = self._split(flat)
        counts = np.zeros(len(texts), np.int64)
        if not len(start):
            return np.zeros(0, np.uint32), counts
        numbers = self._numbers(flat, cps, start, end)
        ids, lens = self.ids.take(numbers)
        counts += np.bincount(np.searchsorted(flat.ends, start), weights=lens, minlength=len(texts)).astype(np.int64)
        return ids, counts

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as uint32, in order. A null text is empty."""
        todo: list[str] = []
        size = 0
        for text in texts:
            todo.append(text or "")
            size += len(todo[-1])
            if size >= CHUNK:
                yield from self._encode(todo)
                todo, size = [], 0
        if todo:
            yield from self._encode(todo)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = self._unsafe(texts)
        ids, counts = self._chunk([("" if i in odd else t) for i, t in enumerate(texts)] if odd else texts)
        end = np.cumsum(counts).tolist()
        last = 0
        for i, e in enumerate(end):
            yield np.array(self._library(texts[i]), np.uint32) if i in odd else ids[last:e]
            last = e

    def _unsafe(self, texts: list[str]) -> set[int]:
        return set()


class FileEncoder(Encoder):
    """A byte-level file of the tokenizers library, with or without word ends."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.lower = spec["normalizer"] is not None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, merged = (np.array(a, np.int64) for a in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.pairs = Pairs(left, right, np.arange(len(pairs)), merged)
        self.reach = max(len(t) for t in vocab)
        shown = byte_characters()
        self.of_byte = np.array([vocab[c] for c in shown], np.int32)
        self.of_last = np.array([vocab[c + self.suffix] for c in shown], np.int32)

    def _unsafe(self, texts: list[str]) -> set[int]:
        safe = _classes()[1]
        odd = set()
        for i, t in enumerate(texts):
            if not t.isascii() and not safe[np.frombuffer(t.encode("utf-32-le"), np.uint32)].all():
                odd.add(i)
        return odd

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _split(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.lower:
            cps = _classes()[2][flat.cps]
            flat.joined = cps.astype("<u4").tobytes().decode("utf-32-le")
            start, end = split_words(flat, cps)
        else:
            cps = flat.cps
            start, end = split_bytes(flat)
        return cps, start, end

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        octets = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.of_byte[octets]
        if self.suffix:
            last = np.cumsum(lens) - 1
            sym[last] = self.of_last[octets[last]]
        return sym, lens


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PieceEncoder(Encoder):
    """A SentencePiece BPE model with byte fallback, identity normaliser and dummy prefix.

    A mark (U+2581) after another character starts a new word: no piece holds a mark behind one,
    which __init__ makes sure of.
    """

    MARK = "▁"

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        size = m.get_piece_size()
        piece = {m.id_to_piece(i): i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        if any(self.MARK in p.lstrip(self.MARK) for p in piece):
            raise ValueError("a piece crosses words")
        self.first_byte = m.piece_to_id("<0x00>")
        self.of_char = np.full(0x110000, -1, np.int32)
        rows = []
        # equal scores are equal ranks: the leftmost place goes first
        by_score = {x: k for k, x in enumerate(sorted({-m.get_score(i) for i in piece.values()}))}
        order = {i: by_score[-m.get_score(i)] for i in piece.values()}
        for p, i in piece.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
            elif any(c not in piece for c in p):
                raise ValueError("a piece holds a character without a piece")
            rows += [(piece[p[:k]], piece[p[k:]], order[i], i) for k in range(1, len(p)) if p[:k] in piece and p[k:] in piece]
        self.pairs = Pairs(*(np.array(a, np.int64) for a in zip(*rows, strict=True)))
        self.reach = max(map(len, piece))

    def _chunk(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return super()._chunk([self.MARK + t.replace(" ", self.MARK) if t else "" for t in texts])

    def _split(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = flat.cps == ord(self.MARK)
        begin = np.r_[True, mark[1:] & ~mark[:-1]]
        begin[flat.ends] = True
        begin[flat.starts] = True
        start = np.flatnonzero(begin)
        end = np.r_[start[1:], len(flat.cps)]
        keep = np.ones(len(flat.cps), bool)
        keep[flat.ends] = False
        keep = keep[start]
        return flat.cps, start[keep], end[keep]

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.of_char[cps]
        # characters without a piece stay apart from ids: -2 - code point
        return np.where(sym >= 0, sym, -2 - cps.astype(np.int64)).astype(np.int32), lens

    def _finish(self, sym: np.ndarray, lens: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(sym < 0)
        if not len(odd):
            return sym, lens
        raw = [chr(-2 - s).encode() for s in sym[odd].tolist()]
        width = np.ones(len(sym), np.int64)
        width[odd] = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.repeat(sym, width)
        octets = np.frombuffer(b"".join(raw), np.uint8)
        out[np.repeat(sym < 0, width)] = octets.astype(np.int32) + self.first_byte
        word = np.repeat(np.arange(len(lens)), lens)
        return out, np.bincount(word, weights=width, minlength=len(lens)).astype(np.int64)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file; its tables and its cache of words live as long."""
    return PieceEncoder(path) if path.endswith(".model") else FileEncoder(path)
