"""Removal of repeated long word sequences by a compacted de Bruijn graph.

The graph's edges are the WINDOW-word k-mers of all texts. Consecutive edges of a text share
nodes; those whose smallest inner KMER-word sequence (the minimizer) is the same one are compacted
to one path before any shuffle. Equal edges have equal minimizers, so a Spark shuffle on the
minimizer meets all occurrences of an edge, and paths that meet under it are joined there:
  - a path with the same words elsewhere is nonbranching: all its edges are repeated at once;
  - a path whose minimizer occurs elsewhere among other words branches: its edges (and those of
    one path of each other kind) are taken from the texts by their source coordinates and joined
    edge by edge;
  - a minimizer that occurs once ends a path: none of its edges is repeated.
Repeated edges become spans of source coordinates, whose words are removed.

What a path or an edge is compared by is a 128-bit digest (XXH3) of its own bytes, taken from the text at its
coordinates. Minimizers are compared by 64-bit hashes of word hashes, but only to meet: two that
collide make a branch, which is resolved by its edges.

Texts are written once, each row under a number of its own and dealt out by it, so the joins that take
places back to texts shuffle the places alone. Before a shuffle, a task combines paths that it has met
itself: they are known to be repeated, and one of them alone goes on for the others, so a passage that
a third of all texts hold reaches the joining task a few times for each task, not once for each text.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A null or empty text has no words. A repeated row counts as
another document, and a null id is kept; all occurrences of a passage are treated alike, so there are
no ties. An empty table gives no rows. Texts of any length are taken whole, one at a time. Further
columns stay as they are, whatever their names: the row is carried in one struct.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagelake.llm.arrow import sliced
from pagelake.session import bucketed, staged

WINDOW = 35
KMER = 20
#: Paths that a task holds to combine.
HOLD = 400_000

#: Column that numbers a row.
KEY = "__row"
REPEATED, BRANCH, OTHER = 0, 1, 2
#: Rows of an output batch.
ROWS = 1 << 16

_A = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to 64-bit hash; starts anew when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_WORDS = _Words()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(14, int(n).bit_length())
        out = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = _POWERS[int(base)] = (out[0], out[1])
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Text:
    """A text's words, hashes of the sequences that start at each word, and digests of any of its spans."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode().split()
        self.n = len(self.words)

    def sequences(self, k: int) -> np.ndarray:
        """A hash of each k words."""
        hashes = np.fromiter(map(_WORDS.__getitem__, self.words), np.uint64, self.n)
        power, inverse = _powers(_A, self.n + 1)
        total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * power[: self.n], out=total[1:])
        at = np.arange(self.n - k + 1)
        return _mixed((total[at + k] - total[at]) * inverse[at])

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two 64-bit halves of the digest of the words of each span, which isn't empty."""
        joined, digest = b" ".join(self.words), xxhash.xxh3_128_digest
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n) + 1)
        a, b = np.r_[0, ends[:-1]][start].tolist(), (ends[end - 1] - 1).tolist()
        return np.frombuffer(b"".join([digest(joined[x:y]) for x, y in zip(a, b, strict=True)]), "<i8").reshape(-1, 2)


def paths(text: Text, window: int = WINDOW, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, content, first edge and number of edges of each compacted path."""
    if text.n < window:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = text.sequences(kmer)
    low = np.lib.stride_tricks.sliding_window_view(small, window - kmer + 1).argmin(axis=1) + np.arange(text.n - window + 1)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    count = np.diff(np.r_[first, len(low)])
    return small[low[first]].view(np.int64), text.digests(first, first + count - 1 + window), first, count


#: Dealt out by deal; a and b are the halves of a digest. flag: 1 is known to be repeated, 2 needs no more meeting.
_DEALT = "deal long, a long, b long, row long, place long, flag byte"
_MET = "row long, place long, kind byte"


def _batches(arrays: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(arrays[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS], f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)


class _Pool:
    """Collects paths or edges of a task until HOLD and then combines them: of those with equal content one
    goes on, and all are known to be repeated."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.parts, self.size = schema, [], 0

    def add(self, row: int, deal: np.ndarray, content: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(deal):
            return
        self.parts.append((deal, content[:, 0], content[:, 1], np.full(len(deal), row, np.int64), place))
        self.size += len(deal)
        if self.size >= HOLD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            deal, a, b, row, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((b, a, deal))
            new = _changes(deal[order], a[order], b[order])
            sizes = np.diff(np.r_[np.flatnonzero(new), len(order)])
            flag = np.empty(len(order), np.int8)
            flag[order] = (~new).astype(np.int8) * 2 + np.repeat(sizes > 1, sizes).astype(np.int8)
            # decided rows travel under a number of their own, which spreads them
            deal = np.where(flag & 2, _mixed(row.view(np.uint64) + place.view(np.uint64)).view(np.int64), deal)
            yield from _batches([deal, a, b, row, place, flag], self.schema)
        self.parts, self.size = [], 0


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any column differs from the row before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


class _Meeting:
    """Judges rows that pass by in order of (deal, content). Of what is still open only the first row of
    the last content is kept, and whether its deal had another content before."""

    def __init__(self) -> None:
        self.head: np.ndarray | None = None  # deal, a, b, row, place of the open content's first row
        self.repeated = self.told = self.many = False

    def take(self, columns: list[np.ndarray], flag: np.ndarray, *, last: bool = False) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(row, place, kind) as arrays for each kind; last: no rows follow."""
        done = flag & 2 != 0
        out = [(columns[3][done], columns[4][done], REPEATED)]
        columns, known = [x[~done] for x in columns], flag[~done] & 1 != 0
        if kept := self.head is not None:
            columns, known = [np.r_[h, x] for h, x in zip(self.head, columns, strict=True)], np.r_[self.repeated, known]
        n = len(columns[0])
        if not n:
            return out
        start = np.flatnonzero(_changes(*columns[:3]))
        size = np.diff(np.r_[start, n])
        repeated = (size > 1) | np.logical_or.reduceat(known, start)
        new_deal = _changes(columns[0][start])
        before = ~new_deal
        before[0] = kept and self.many
        many = before | np.r_[~new_deal[1:], False]
        emit = np.repeat(repeated, size)
        if kept and self.told:
            emit[0] = False
        out.append((columns[3][emit], columns[4][emit], REPEATED))
        closed = np.ones(len(start), bool)
        closed[-1] = last
        for kind, rule in ((OTHER, repeated), (BRANCH, ~repeated)):
            heads = start[closed & many & rule]
            out.append((columns[3][heads], columns[4][heads], kind))
        at = start[-1]
        self.head = None if last else np.array([x[at] for x in columns], np.int64)
        self.repeated = self.told = bool(repeated[-1])
        self.many = bool(before[-1])
        return out


def _judged(rows: DataFrame) -> DataFrame:
    """(row, place, kind) of paths or edges that meet others: REPEATED, BRANCH, or OTHER (what a branch is held against)."""
    schema = StructType.fromDDL(_MET)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting()

        def rows_of(found: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*((r, p, np.full(len(r), kind, np.int8)) for r, p, kind in found), strict=True)]
            yield from _batches(columns, arrow)

        for batch in batches:
            *columns, flag = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield from rows_of(meeting.take(columns, flag))
        nothing = np.zeros(0, np.int64)
        yield from rows_of(meeting.take([nothing] * 5, nothing.astype(np.int8), last=True))
        pa.default_memory_pool().release_unused()

    dealt = rows.repartition("deal").sortWithinPartitions("deal", "a", "b")
    return dealt.mapInArrow(run, schema)


def _places(rows: DataFrame) -> DataFrame:
    """All places of a row; their number is bounded by its words."""
    return rows.groupBy(F.col("row").alias(KEY)).agg(F.collect_set("place").alias("__places"))


def _texts(docs: DataFrame, text_column: str) -> DataFrame:
    """Numbered rows: KEY, __text, and as row all other columns. Written once, so a number never changes."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_column))
    return bucketed(docs.select(F.monotonically_increasing_id().alias(KEY), F.col(f"`{text_column}`").alias("__text"), rest.alias("row")), "texts", KEY)


def repeated(texts: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(row, place): edges first << 8 | count of numbered texts (KEY, __text) that occur elsewhere too."""
    dealt = StructType.fromDDL(_DEALT)
    arrow = to_arrow_schema(dealt)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(arrow)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                deal, content, first, count = paths(Text(text.as_py()), window, kmer)
                yield from pool.add(key, deal, content, first << 8 | count)
        yield from pool.flush()
        pa.default_memory_pool().release_unused()

    judged = staged(_judged(texts.select(KEY, "__text").mapInArrow(compact, dealt)), "paths")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(arrow)
        for batch in batches:
            for key, text, places in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                place = places.values.to_numpy()
                first, count = place >> 8, place & 255
                start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                content = Text(text.as_py()).digests(start, start + window)
                yield from pool.add(key, content[:, 0], content, start << 8 | 1)
        yield from pool.flush()
        pa.default_memory_pool().release_unused()

    branches = _places(judged.where(F.col("kind") != REPEATED))
    met = _judged(texts.join(branches, KEY).select(KEY, "__text", "__places").mapInArrow(edges, dealt))
    met = met.where(F.col("kind") == REPEATED)
    return judged.where(F.col("kind") == REPEATED).unionByName(met).select("row", "place")


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Words of n that the edges at these places cover."""
    step = np.zeros(n + 1, np.int64)
    first = places >> 8
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + (places & 255) - 1 + window, n), -1)
    return np.cumsum(step[:n]) > 0


def _removed(docs: DataFrame, window: int, kmer: int, text_column: str, untouched: bool) -> DataFrame:
    """row (the input's, in one struct), text, n_words, n_removed."""
    if not kmer <= window <= kmer + 200:
        raise ValueError("a path's edges must fit its place")
    texts = _texts(docs, text_column)
    joined = texts.join(_places(repeated(texts, window, kmer)), KEY, "left").select("row", "__text", "__places")
    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    arrow = to_arrow_schema(schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                texts, words_, removed = [], [], []
                for text, places in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    t = Text(text)
                    gone = covered(t.n, places.values.to_numpy(), window) if places.is_valid else np.zeros(t.n, bool)
                    if not untouched or gone.any():
                        text = b" ".join(itertools.compress(t.words, (~gone).tolist())).decode()
                    texts.append(text)
                    words_.append(t.n)
                    removed.append(int(gone.sum()))
                made = [pa.array(texts, arrow.field(1).type), pa.array(words_, pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *made], schema=arrow)
        pa.default_memory_pool().release_unused()

    return joined.mapInArrow(remove, schema)


def deduplicate(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_removed and, as text, the kept words joined by one space, of every row."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return _removed(rows, window, kmer, "text", False).select(F.col("row.id").alias(id_column), "n_words", "n_removed", "text")


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, text_column: str = "text") -> DataFrame:
    """The rows of docs; texts of which nothing is removed stay as they are, with white space or null."""
    rows = _removed(docs, window, kmer, text_column, True)
    return rows.select(*(F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns))
