"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its top 4 bits and a fixed count of ids of one width in the
other 60. An id that needs over 60 bits is an escape: selector 15, whose payload is the place in
the file's list of exceptions. Blocks of BLOCK ids start at a word of their own; the file lists
each block's first word, so that all blocks decode at once or any of them alone.

One file (a "shard"), little-endian:
  magic S8B1 | uint32 block size | int64 documents, ids, blocks, words, exceptions
  int64 doc_id[documents] | uint8 doc_id is null[documents] | int64 ids of each document[documents]
  int64 first word[blocks + 1] | uint64 words[words] | uint64 exceptions[exceptions]

Shards are the binary column of a Parquet table that Spark writes and commits, so a lost executor
leaves no half-written file; (part, first) gives their order. Within a part, documents ascend by
doc_id (null first, ties by text), and parts ascend too.

Nulls: a null text is an empty one, a null doc_id is kept. Each row of the input is one document,
also when repeated. An empty table gives no shard. A very long text is a shard of its own. Only the id
and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.arrow import map_rows, only, partition
from pagelake.llm.bpe import encoder

# Fixed values of the format: ids in a word, and their width, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
MAGIC = b"S8B1"
BLOCK = 1024
#: Ids of a shard, but for one longer document.
SHARD = 1 << 20


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    w = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    large = np.flatnonzero(ids >> np.uint64(53))  # beyond what a double holds exactly
    w[large] = [int(x).bit_length() for x in ids[large].tolist()]
    return w


def _selectors(width: np.ndarray, block: int) -> np.ndarray:
    """Of each id the selector with most ids of which all from it on fit, within its block."""
    n, longest = len(width), int(COUNTS[0])
    rows = -(-n // block)
    # behind a block nothing fits, so a selector never reaches into the next one
    padded = np.full((rows, block + longest), 255, np.uint8)
    flat = np.full(rows * block, 255, np.uint8)
    flat[:n] = width
    padded[:, :block] = flat.reshape(rows, block)
    best = np.full((rows, block), len(COUNTS) - 1, np.uint8)
    most, span = padded, 1  # the widest of so many ids from each on
    for s in range(len(COUNTS) - 2, -1, -1):
        while span < COUNTS[s]:
            step = min(span, int(COUNTS[s]) - span)
            most = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
            span += step
        best[most[:, :block] <= WIDTHS[s]] = s
    return best.reshape(-1)[:n]


def pack_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each block's first word (and the end), exceptions."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    width = _widths(ids)
    best = _selectors(width, block)
    step = COUNTS.astype(np.uint8)[best]
    at = np.arange(0, n, block)
    end = np.minimum(at + block, n)
    begun = []
    owner = np.arange(len(at))
    while len(at):
        begun.append((owner, at))
        at = at + step[at]
        go = at < end
        at, end, owner = at[go], end[go], owner[go]
    own, start = (np.concatenate(x) for x in zip(*begun, strict=True))
    start.sort()
    first = np.r_[0, np.cumsum(np.bincount(own))]
    sel = best[start].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(len(COUNTS)):
        of = np.flatnonzero(sel == s)
        if len(of):
            got = ids[start[of][:, None] + np.arange(COUNTS[s])]
            words[of] |= np.bitwise_or.reduce(got << (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64), axis=1) if s < 13 else np.where(width[start[of]] > 60, 0, got[:, 0])
    odd = np.flatnonzero(width[start] > 60)
    exceptions = ids[start[odd]]
    words[odd] = (np.uint64(ESCAPE) << np.uint64(60)) | np.arange(len(odd), dtype=np.uint64)
    return words, first, exceptions


def unpack_words(words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """All ids of consecutive words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.r_[COUNTS, 0, 1][sel]
    ends = np.cumsum(count)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for s in range(len(COUNTS)):
        of = np.flatnonzero(sel == s)
        if len(of):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            out[(ends - count)[of][:, None] + np.arange(COUNTS[s])] = (body[of][:, None] >> shift) & np.uint64((1 << int(WIDTHS[s])) - 1)
    of = sel == ESCAPE
    out[(ends - count)[of]] = exceptions[body[of].astype(np.int64)]
    return out


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    words, first, exceptions = pack_words(flat)
    head = MAGIC + struct.pack("<I5q", BLOCK, len(ids), len(flat), len(first) - 1, len(words), len(exceptions))
    return b"".join([
        head,
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array([len(x) for x in ids], "<i8").tobytes(), first.astype("<i8").tobytes(), words.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes(),
    ])


class Shard:
    """Reads a shard; blocks decode alone or together."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        self.block, docs, self.n_ids, blocks, n_words, n_exc = struct.unpack_from("<I5q", raw, 4)
        at = 4 + struct.calcsize("<I5q")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes
            return a

        doc_ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else x for x, z in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        self.doc_lens = take("<i8", docs)
        self.first, self.words, self.exceptions = take("<i8", blocks + 1), take("<u8", n_words), take("<u8", n_exc)
        if at != len(raw):
            raise ValueError("a token file of another length")

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids start to end, from their blocks alone."""
        end = self.n_ids if end is None else end
        if end <= start:
            return np.zeros(0, np.uint64)
        a, b = start // self.block, -(-end // self.block)
        got = unpack_words(self.words[self.first[a] : self.first[b]], self.exceptions)
        return got[start - a * self.block : end - a * self.block]


def write(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every document, append end_id, and write the shards to a Parquet table at out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, first, keys, ids, size = partition(), 0, [], [], 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for key, got in zip(batch.column(0).to_pylist(), encoder(tokenizer_path).encode(texts), strict=True):
                keys.append(key)
                ids.append(np.concatenate([got, end]))
                size += len(ids[-1])
                if size >= SHARD:
                    yield part, first, size, write_shard(keys, ids)
                    first, keys, ids, size = first + size, [], [], 0
        if keys:
            yield part, first, size, write_shard(keys, ids)

    rows = only(docs, id_column, text_column, text=text_column)
    ranged = rows.repartitionByRange(F.col(id_column).asc_nulls_first()).sortWithinPartitions(F.col(id_column).asc_nulls_first(), text_column)
    map_rows(ranged, run, "part int, first long, n_ids long, shard binary").write.parquet(out)


def read(spark: SparkSession, path: str, of_ids: Callable[[np.ndarray], tuple], columns: str) -> DataFrame:
    """(doc_id, start, n_tokens, *columns) of each document; of_ids makes the columns from its ids."""
    shards = spark.read.schema("part int, first long, n_ids long, shard binary").parquet(path)
    # one row a part, so as many as the write had tasks: small enough to broadcast at any size
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        offsets[r.part] = total
        total += r.n
    shared = spark.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, first, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "shard")), strict=True):
                shard = Shard(raw)
                ids = shard.ids().astype(np.uint32)
                at, start = 0, shared.value[part] + first
                for key, n in zip(shard.doc_ids, shard.doc_lens.tolist(), strict=True):
                    yield key, start + at, n, *of_ids(ids[at : at + n])
                    at += n

    return map_rows(shards.select("part", "first", "shard"), run, f"doc_id long, start long, n_tokens long, {columns}")


def crc_column(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
