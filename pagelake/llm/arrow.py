"""Arrow batches in, Arrow batches out."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an output batch.
ROWS = 4096


def only(df: DataFrame, *columns: str, text: str | None = None) -> DataFrame:
    """The named columns alone, so that others never clash; text null becomes empty."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == text else F.col(c) for c in columns])


def partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def sliced(batch: pa.RecordBatch, text: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with so many bytes of the text column at most, but for one longer text."""
    widths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(widths, dtype=np.int64) // size)) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def map_rows(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """make: a partition's batches to tuples of the schema. Tuples leave in small batches."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def batches(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in make(source):
            rows.append(row)
            size += sum(len(x) for x in row if hasattr(x, "__len__"))
            if len(rows) >= ROWS or size > 1 << 22:
                yield batches(rows)
                rows, size = [], 0
        if rows:
            yield batches(rows)
        pa.default_memory_pool().release_unused()  # a worker waits beside others for its next task

    return df.mapInArrow(run, kind)
