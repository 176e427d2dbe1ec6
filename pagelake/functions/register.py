"""Value codecs as functions over Arrow batches, for DataFrames and (after register) for SQL.

Batches travel as Arrow; within one, a value's bytes are read by Python, one at a time."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, udtf

from pagelake.codec import heap, values


def _each(f: Callable, kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], kind)

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return run


#: Name in SQL, function of one value, and type.
FUNCTIONS = {
    "pg_numeric_text": (values.numeric_text, "string"),
    "pg_numeric_bytes": (values.numeric_bytes, "binary"),
    "pg_numeric_copy_text": (values.numeric_text_of_copy, "string"),
    "pg_jsonb_text": (values.jsonb_text, "string"),
    "pg_jsonb_bytes": (values.jsonb_bytes, "binary"),
    "pg_varlena": (lambda x: heap.read_varlena(x, 0)[0], "binary"),
}


@functools.cache
def function(name: str) -> Callable[..., Column]:
    """A function by its SQL name. Made when it is asked for, as workers import this module too."""
    f, kind = FUNCTIONS[name]
    return arrow_udf(_each(f, pa.string() if kind == "string" else pa.binary()), kind)


def long_row(key: str, size: Column) -> Column:
    """Attributes of (int8, long value): the value is stored in chunks under the key."""

    def rows(keys: pa.Array, sizes: pa.Array) -> pa.Array:
        both = zip(keys.to_pylist(), sizes.to_pylist(), strict=True)
        return pa.array([k.to_bytes(8, "little", signed=True) + heap.make_pointer(n + 4, n, k, 0) for k, n in both], pa.binary())

    rows.__annotations__ = {"keys": pa.Array, "sizes": pa.Array, "return": pa.Array}
    return arrow_udf(rows, "binary")(F.col(key), size)


class HeapPageTuples:
    """The normal tuples of a page."""

    def eval(self, page: bytes):
        for t in heap.tuples(bytes(page)) if page is not None else ():
            yield t.offset, t.xmin, t.xmax, t.infomask2, t.infomask, t.bitmap, t.attrs


def register(spark: SparkSession) -> None:
    """pg_numeric_text, pg_numeric_bytes, pg_jsonb_text, pg_jsonb_bytes, pg_varlena, lsn_text, heap_page_tuples."""
    for name in FUNCTIONS:
        spark.udf.register(name, function(name))
    spark.udtf.register("heap_page_tuples", udtf(HeapPageTuples, returnType="offnum int, xmin long, xmax long, infomask2 int, infomask int, bitmap binary, attrs binary"))
    spark.sql("create or replace temporary function lsn_text(l bigint) returns string return concat(hex(shiftrightunsigned(l, 32)), '/', hex(l & 4294967295))")

