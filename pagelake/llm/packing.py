"""Harmonic packing of token sequences.

A document is cut into whole sequences and a rest. The rest goes to the class of the reciprocal
that it nearly fills: class k holds pieces of at most capacity // k ids, and k of them fill a
sequence. A rest that would leave much of its slot empty first gives up a piece of exactly the
next smaller slot. Each worker fills each class's sequences with a fixed count of pieces, apart
from all others and without a shuffle. The unfinished sequences of a worker hold fewer than k
pieces a class; those of GROUP workers together are packed by first-fit decreasing.

Nulls: a null text is an empty document (the end id alone); a null doc_id is kept. Each row is a
document, also when repeated. An empty table gives no piece. A very long text is cut to as many whole
sequences as it fills. Pieces of equal length fill a class in the order in which they come, in the rest by
worker, id and start. Only the id and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pagelake.llm.arrow import map_rows, only, partition
from pagelake.llm.bpe import encoder
from pagelake.session import staged

CAPACITY = 4096
#: A rest of at most this share of the capacity is never cut.
SMALL = 16
#: The part of a slot that a piece may leave empty.
SLACK = 64
#: Workers whose unfinished sequences are packed together.
GROUP = 64


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n ids, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if rest * SMALL <= capacity or (slot - rest) * SLACK <= slot:
            pieces.append((rest, k))
            break
        pieces.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return pieces


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; sequences are kept by the room they have left."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    out = [(0, 0)] * len(lengths)
    largest = np.zeros(capacity + 1, bool)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = np.flatnonzero(largest[lengths[i] :])
        if len(fits):
            left = lengths[i] + int(fits[0])
            b = room[left].pop()
            largest[left] = bool(room[left])
        else:
            b, left = len(used), capacity
            used.append(0)
        out[i] = (b, used[b])
        used[b] += lengths[i]
        left -= lengths[i]
        room[left].append(b)
        largest[left] = left > 0
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    key = docs.schema[id_column]
    fields = [key, *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    schema = StructType([*fields, StructField("worker", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        worker, made = partition(), 0
        filling: dict[int, list[tuple]] = {}
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), encoder(tokenizer_path).encode(batch.column(1).to_pylist()), strict=True):
                ids, start = np.concatenate([got, end]), 0
                for length, k in cut(len(ids), capacity):
                    piece = ids[start : start + length]
                    row = (doc, start, length, zlib.crc32(piece.astype("<u4").tobytes()), len(ids))
                    start += length
                    bin_ = filling.setdefault(k, [])
                    bin_.append((row, (piece.astype(np.int32),) if with_ids else ()))
                    if len(bin_) == k:
                        offset = 0
                        for r, x in bin_:
                            yield *r, worker << 32 | made, offset, *x, worker
                            offset += r[2]
                        made += 1
                        del filling[k]
        for bin_ in filling.values():
            for r, x in bin_:
                yield *r, None, None, *x, worker

    pieces = staged(map_rows(only(docs, id_column, text_column, text=text_column), run, schema), "pieces")
    names = [f.name for f in schema if f.name != "worker"]

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["worker", id_column, "start"], kind="stable").reset_index(drop=True)
        got = first_fit(group["length"].tolist(), capacity)
        first = (int(group["worker"].iloc[0]) // GROUP) << 32 | 1 << 62
        return group.assign(sequence_id=[first + s for s, _ in got], offset=[o for _, o in got])[names]

    rest = pieces.where(F.col("sequence_id").isNull()).groupBy(F.floor(F.col("worker") / GROUP)).applyInPandas(finish, StructType(fields))
    return pieces.where(F.col("sequence_id").isNotNull()).select(*names).unionByName(rest)
