"""Heap pages as DataFrames: tuples, visible rows, building, checksums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelake.codec import bits, heap
from pagelake.codec.heap import Column
from pagelake.operators import visibility

_TUPLE = "offnum int, xmin long, xmax long, ctid long, infomask2 int, infomask int, bitmap binary, attrs binary"


def batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _carried(pages: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name != "page")


def _tuple_row(t: heap.Tuple) -> tuple:
    return t.offset, t.xmin, t.xmax, t.ctid[0] << 16 | t.ctid[1], t.infomask2, t.infomask, t.bitmap, t.attrs


def tuples(pages: DataFrame) -> DataFrame:
    """Every normal tuple of each page, with the page's other columns."""
    schema = StructType.fromDDL(f"{_carried(pages)}, {_TUPLE}")
    keep = [c for c in pages.columns if c != "page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*r, *_tuple_row(t)) for *r, page in zip(*(x.to_pylist() for x in b.columns), strict=True) if page is not None for t in heap.tuples(page)]
            yield batch(rows, schema)

    return pages.select(*keep, "page").mapInArrow(run, schema)


def chains(pages: DataFrame) -> DataFrame:
    """Every version of each chain: root, depth and the tuple. Which one counts is left to visibility."""
    schema = StructType.fromDDL(f"{_carried(pages)}, root int, depth int, {_TUPLE}")
    keep = [c for c in pages.columns if c != "page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *r, page in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if page is None:
                    continue
                items = heap.pointers(page)
                for root, first in heap.roots(page, items):
                    rows += [(*r, root, d, *_tuple_row(t)) for d, t in enumerate(heap.chain(page, first, items=items))]
            yield batch(rows, schema)

    return pages.select(*keep, "page").mapInArrow(run, schema)


def visible(pages: DataFrame, status: DataFrame, updaters: DataFrame | None = None) -> DataFrame:
    """The visible version of each chain, addressed by its root (offnum)."""
    keep = [c for c in pages.columns if c != "page"]
    judged = visibility.visible(chains(pages), status, updaters).where("visible")
    rank = F.row_number().over(Window.partitionBy(*keep, "root").orderBy("depth"))
    return judged.withColumn("__n", rank).where("__n = 1").withColumn("offnum", F.col("root")).drop("__n", "root", "depth", "visible")


def decode(rows: DataFrame, columns: list[Column], *, carry: bool = False) -> DataFrame:
    """Values of the live columns of tuple rows (infomask2, bitmap, attrs), which may have __chunks, a
    map of value id to stored bytes (with_chunks). Rows that can't be decoded have the reason in
    decode_error and null values, to be routed aside; so have rows without a tuple.

    carry: long values whose chunks are unknown are no error but listed in unresolved, to be taken from
    the version before (records.carried)."""
    live = [c for c in columns if not c.dropped]
    carried = [c for c in rows.columns if c not in ("bitmap", "attrs", "__chunks")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in carried)
    more = ", unresolved array<string>" if carry else ""
    schema = StructType.fromDDL(f"{fields}, {', '.join(f'{c.name} {_stored(c)}' for c in live)}, decode_error string{more}")
    chunks = [F.col("__chunks")] if "__chunks" in rows.columns else [F.lit(None).cast("map<bigint,binary>")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i2 = carried.index("infomask2")
        for b in batches:
            out = []
            for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                stored, got, error, missing = dict(r[-1] or ()), [None] * len(live), None, []
                try:
                    if r[i2] is None or r[-2] is None:
                        raise heap.FormatError("the tuple is unknown")
                    got = heap.decode_attrs(columns, r[i2] & heap.NATTS, r[-3], r[-2], lambda p, stored=stored: stored.get(p.value_id), [heap.UNRESOLVED] * len(live) if carry else None)
                    missing = [c.name for c, v in zip(live, got, strict=True) if v is heap.UNRESOLVED]
                    got = [None if v is heap.UNRESOLVED else v for v in got]
                except heap.FormatError as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((*r[:-3], *got, error, *([missing] if carry else [])))
            yield batch(out, schema)

    done = rows.select(*carried, "bitmap", "attrs", *chunks).mapInArrow(run, schema)
    return done.withColumns({c.name: _shown(c) for c in live if c.type in ("date", "timestamp", "timestamptz")})


def _stored(c: Column) -> str:
    return {"date": "int", "timestamp": "bigint", "timestamptz": "bigint"}.get(c.type, c.spark)


def _shown(c: Column):
    if c.type == "date":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.col(c.name))
    moment = F.timestamp_micros(c.name)
    return moment.cast("timestamp_ntz") if c.type == "timestamp" else moment


def build(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Pages of rows: rel, block, slot, xmin, xmax, and the live columns. Slots that no row has are unused.

    With a column kind, a slot may also be "dead", "redirect" (to the slot in target) or "raw" (the whole
    tuple in raw); null is a row as without it. A page is one block's tuples, so a group holds 8 KB at most."""
    live = [c.name for c in columns if not c.dropped]
    rows = rows.withColumns({c.name: _unshown(c) for c in columns if not c.dropped and c.type in ("date", "timestamp", "timestamptz")})
    schema = StructType.fromDDL("rel long, block long, page binary")

    def slot(r: dict, block: int) -> tuple:
        kind = r.get("kind") or "row"
        if kind == "redirect":
            return kind, r["target"]
        if kind == "raw":
            return "tuple", r["raw"]
        if kind != "row":
            return (kind,)
        return "tuple", heap.make_tuple(columns, [r[c] for c in live], r["xmin"], r["xmax"], (block, r["slot"]))

    def make(key: tuple, group: pa.Table) -> pa.Table:
        rel, block = (k.as_py() for k in key)
        found = group.to_pylist()
        slots = {r["slot"]: slot(r, block) for r in found}
        lsn = max((r["xmin"] or 0) for r in found)
        page = heap.build_page([slots.get(i, ("unused",)) for i in range(1, max(slots) + 1)], block, lsn)
        return pa.Table.from_batches([batch([(rel, block, page)], schema)])

    return rows.groupBy("rel", "block").applyInArrow(make, schema)


def _unshown(c: Column):
    if c.type == "date":
        return F.datediff(F.col(c.name), F.lit("1970-01-01").cast("date"))
    return F.unix_micros(F.col(c.name).cast("timestamp"))


def verified(pages: DataFrame) -> DataFrame:
    """stored and computed checksum of each page (block, page), and if they agree."""
    schema = StructType.fromDDL(f"{_carried(pages)}, stored int, computed int, valid boolean")
    keep = [c for c in pages.columns if c != "page"]
    at = keep.index("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *rest, raw = (x.to_pylist() for x in b.columns)
            got = bits.page_checksums(raw, rest[at]).tolist()
            stored = [int.from_bytes(p[8:10], "little") for p in raw]
            yield batch([(*r, s, g, s == g) for *r, s, g in zip(*rest, stored, got, strict=True)], schema)

    return pages.select(*keep, "page").mapInArrow(run, schema)


def pointers(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """value_id, size and raw_size of each long value that a tuple row points to, with the row's other columns."""
    carried = [c for c in rows.columns if c not in ("bitmap", "attrs")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in carried)
    schema = StructType.fromDDL(f"{fields}, value_id long, size int, raw_size int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [*carried, "bitmap", "attrs"].index("infomask2")
        for b in batches:
            out = []
            for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                met: list[heap.Pointer] = []
                heap.decode_attrs(columns, r[at] & heap.NATTS, r[-2], r[-1], lambda p, met=met: met.append(p), old=[None] * len(columns))
                out += [(*r[:-2], p.value_id, p.size, p.raw_size) for p in met]
            yield batch(out, schema)

    return rows.select(*carried, "bitmap", "attrs").mapInArrow(run, schema)


def reassembled(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """data of long values from chunks (keys, seq, data): joined in order if none is missing, else null.

    A value's chunks are one value in the end, so the group is bounded by what a value may hold."""
    each = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("c"))
    whole = F.expr("exists(transform(c, (x, i) -> x.seq <> i), x -> x)")
    return each.select(*keys, F.when(~whole, F.expr("unhex(array_join(transform(c, x -> hex(x.data)), ''))")).alias("data"))


def with_chunks(rows: DataFrame, columns: list[Column], chunks: DataFrame, key: list[str]) -> DataFrame:
    """Tuple rows with the stored bytes of their long values. chunks: value_id, seq, data; key names a row."""
    asked = pointers(rows.select(*key, "infomask2", "bitmap", "attrs"), columns).select(*key, "value_id")
    met = asked.join(reassembled(chunks, ["value_id"]).where("data is not null"), "value_id")
    of = met.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("value_id", "data"))).alias("__chunks"))
    return rows.join(of, key, "left")


def toast_chunks(pages: DataFrame) -> DataFrame:
    """value_id, seq and data of the chunks on pages of a relation that holds long values."""
    schema = StructType.fromDDL("value_id long, seq int, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([heap.toast_chunk(a) for a in b.column(0).to_pylist()], schema)

    return tuples(pages).select("attrs").mapInArrow(run, schema)


def block_counts(pages: DataFrame) -> DataFrame:
    """Blocks of each relation: one more than the highest."""
    return pages.groupBy("rel").agg((F.max("block") + 1).alias("n_blocks"))


def block_ranges(pages: DataFrame) -> DataFrame:
    return pages.groupBy("rel").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.count("*").alias("n"))
