"""Queries of file, message and compressed formats: what is written in a format must read back as its source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.codec import bits, files, heap, wal
from pagelake.functions import register as R
from pagelake.operators import changelog, pages, records, visibility
from pagelake.plans.codecs import CUSTOMER, customer_pages, event_log
from pagelake.plans.lake import SQL_CODE, status_pages
from pagelake.plans.registry import register
from pagelake.session import staged, table
from pagelake.sources import files as sources
from pagelake.sources import replication

_CUSTOMER = "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"


@register("wal_page_images", _CUSTOMER)
def wal_page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' pages as page images of log records, in turn plain, pglz, lz4 and zstd, without the hole
    between pointers and tuples; each record names the tuples that it wrote."""
    made = customer_pages(spark, sf).withColumn("segment", F.lit(0).cast("long") + F.expr("block div 400"))

    def make(group: pd.DataFrame) -> list[bytes]:
        out = []
        for block, page in sorted(zip(group["block"].tolist(), group["page"].tolist(), strict=True)):
            lower, upper = struct.unpack_from("<HH", page, 12)
            short = page[:lower] + page[upper:]
            kind, raw = [
                (0, lambda x: x), (wal.IMAGE_PGLZ, bits.pglz_literals), (wal.IMAGE_LZ4, lambda x: pa.Codec("lz4_raw").compress(x).to_pybytes()), (wal.IMAGE_ZSTD, lambda x: pa.Codec("zstd").compress(x).to_pybytes()),
            ][block % 4]
            offsets = [t.offset for t in heap.tuples(page)]
            main = struct.pack(f"<BBH{len(offsets)}H", 0, 0, len(offsets), *offsets)
            out.append(wal.build(1, wal.HEAP2, 0x50, main, [((1663, 5, 16384), block, b"", (raw(short), lower, upper - lower, wal.IMAGE_HOLE | kind))]))
        return out

    ops = records.operations(records.parsed(records.framed(records.build_segments(made, make))))
    return pages.decode(ops, CUSTOMER).where("decode_error is null").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _periodic(text: bytes, times: int) -> bytes:
    """pglz of a text that repeats: its bytes once, then references back to them."""
    items = [(False, bytes([c])) for c in text]
    left, back = len(text) * (times - 1), len(text)
    while left >= 3:
        n = min(left, 273)
        n = n if left - n == 0 or left - n >= 3 else n - 3
        long = b"" if n < 18 else bytes([n - 18])
        items.append((True, bytes([(back & 0xF00) >> 4 | (min(n, 18) - 3), back & 0xFF]) + long))
        left -= n
    out = b""
    for i in range(0, len(items), 8):
        part = items[i : i + 8]
        out += bytes([sum(1 << k for k, (ref, _) in enumerate(part) if ref)]) + b"".join(x for _, x in part)
    return out


@register("compressed_values", "select p_partkey, repeat(p_name || '.', 2 + (p_partkey % 60)::int) as body from part")
def compressed_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values compressed in place, in turn by pglz (with references) and lz4."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one, times = (name + ".").encode(), 2 + k % 60
                method = k % 2
                body = pa.Codec("lz4_raw").compress(one * times).to_pybytes() if method else _periodic(one, times)
                out.append(struct.pack("<II", (len(body) + 8) << 2 | 2, len(one) * times | method << 30) + body)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["p_partkey", "raw"])

    rows = p.mapInArrow(compress, "p_partkey long, raw binary")
    return rows.select("p_partkey", R.function("pg_varlena")("raw").cast("string").alias("body"))


@register("toast_pages_reassemble", "select doc_id, text from documents where text is not null")
def toast_pages_reassemble(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts as chunks on the pages of a relation of their own."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / 1996)).cast("int")
    chunks = d.select("doc_id", "b", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("seq", "i"))
    chunks = chunks.select("doc_id", "seq", F.expr("substring(b, i * 1996 + 1, 1996)").alias("data"), (F.col("doc_id") * 100_000 + F.expr("seq div 4")).alias("block"))

    def make(key: tuple, group: pa.Table) -> pa.Table:
        slots = []
        for r in sorted(group.to_pylist(), key=lambda r: r["seq"]):
            attrs = struct.pack("<IiI", r["doc_id"], r["seq"], (len(r["data"]) + 4) << 2) + r["data"]
            slots.append(("tuple", heap.raw_tuple(5, 0, (0, len(slots) + 1), 3, heap.XMAX_INVALID, b"", attrs)))
        return pa.table({"block": [key[0].as_py()], "page": [heap.build_page(slots, key[0].as_py() & 0xFFFFFFFF, 1)]}, pa.schema([("block", pa.int64()), ("page", pa.binary())]))

    made = chunks.groupBy("block").applyInArrow(make, "block long, page binary")
    whole = pages.reassembled(pages.toast_chunks(made), ["value_id"])
    return whole.where("data is not null").select(F.col("value_id").alias("doc_id"), F.decode("data", "UTF-8").alias("text"))


@register("lateral_page_tuples", "select c_custkey // 60 as block, c_custkey % 60 + 1 as offnum, 700 as xmin from customer")
def lateral_page_tuples(spark: SparkSession, sf: str) -> DataFrame:
    """The table function of SQL over pages."""
    R.register(spark)
    return spark.sql("select block, t.offnum, t.xmin from {pages}, lateral heap_page_tuples(page) t", pages=customer_pages(spark, sf))


@register("reshaped_rows", "select o_orderpriority, cast(null as varchar) as note, o_custkey from orders")
def reshaped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an old column order in a new one."""
    return changelog.reshape(table(spark, sf, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], ["o_orderpriority", "note", "o_custkey"], {})


@register("status_files_read", f"select event_id as xid, {SQL_CODE} as status from events")
def status_files_read(spark: SparkSession, sf: str) -> DataFrame:
    """Status pages in segment files of 32 pages each."""
    part = status_pages(spark, sf).groupBy(F.expr("page_no div 32").alias("segment")).agg(F.sort_array(F.collect_list(F.struct("page_no", F.hex("page").alias("h")))).alias("l"))
    content = F.unhex(F.array_join(F.expr("transform(l, x -> rpad(x.h, 16384, '0'))"), ""))
    named = part.select(F.concat(F.lit("/pg_xact/"), F.lpad(F.hex("segment"), 4, "0")).alias("path"), content.alias("content"))
    codes = visibility.statuses(sources.status_pages(named))
    return codes.join(table(spark, sf, "events").select(F.col("event_id").alias("xid")), "xid", "left_semi")


@register("heap_files_read", _CUSTOMER)
def heap_files_read(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' pages in relation files of ten pages, named by relation and segment."""

    def make(key: tuple, group: pa.Table) -> pa.Table:
        found = {r["block"] % 10: r["page"] for r in group.to_pylist()}
        raw = b"".join(found.get(i, bytes(heap.PAGE)) for i in range(max(found) + 1))
        name = "/base/5/16384" + (f".{key[0].as_py()}" if key[0].as_py() else "")
        return pa.table({"path": [name], "content": [raw]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    content = customer_pages(spark, sf).withColumn("file", F.expr("block div 10")).groupBy("file").applyInArrow(make, "path string, content binary")
    found = sources.heap_pages(content, 10).where("rel = 16384 and page <> unhex(repeat('00', 8192))")
    return pages.decode(pages.tuples(found), CUSTOMER).where("decode_error is null").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("index_rows_from_pages", "select s_suppkey + 16384 as indrelid, s_suppkey % 3 + 1 as key, s_suppkey % 2 = 0 as indisprimary from supplier")
def index_rows_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of pg_index to its rows."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.expr("s_suppkey div 50").alias("block"))

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        slots = []
        for k in sorted(int(k) for k in group["s_suppkey"]):
            attrs = struct.pack("<IIhh", 0, 16384 + k, 2, 1).ljust(14, b"\0") + bytes([k % 2 == 0])
            attrs = attrs.ljust(40, b"\0") + struct.pack("<i", 1) + bytes(4) + struct.pack("<hh", k % 3 + 1, 5)
            slots.append(("tuple", heap.raw_tuple(3, 0, (int(key[0]), len(slots) + 1), 20, heap.XMAX_INVALID, b"", attrs)))
        return pd.DataFrame({"rel": [2610], "block": [int(key[0])], "page": [heap.build_page(slots, int(key[0]), 1)]})

    made = rows.groupBy("block").applyInPandas(make, "rel long, block long, page binary")
    found = sources.catalog_rows(pages.tuples(made), "pg_index")
    return found.select("indrelid", F.get("indkey", F.lit(0)).alias("key"), "indisprimary")


@register("relation_map_rows", "select n_nationkey + 1000 as oid, n_nationkey + 2000 as relfilenode from nation")
def relation_map_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A map file of all nations, which a map holds at most 62 of."""

    def make(group: pa.Table) -> pa.Table:
        keys = group.column(0).to_pylist()
        pairs = [x for k in keys for x in (k + 1000, k + 2000)]
        return pa.table({"content": [struct.pack(f"<Ii{len(pairs)}I", files.RELMAP_MAGIC, len(keys), *pairs).ljust(524, b"\0")]}, pa.schema([("content", pa.binary())]))

    content = table(spark, sf, "nation").select("n_nationkey").withColumn("map", F.lit(0)).groupBy("map").applyInArrow(make, "content binary")
    return sources._mapped(content, "oid long, relfilenode long", lambda raw: files.relation_map(raw).items())


@register("stream_messages_records", "select 'insert' as operation, count(*) as n from events union all select 'outcome', count(*) from (select 1 from events group by event_id having event_id % 7 = 6)")
def stream_messages_records(spark: SparkSession, sf: str) -> DataFrame:
    """A log that comes in messages of odd sizes, with keepalives between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages(start: int, raw: bytes) -> Iterator[bytes]:
            for i in range(0, len(raw), 999):
                yield b"w" + struct.pack(">QQq", start + i, start + len(raw), 0) + raw[i : i + 999]
                yield b"k" + struct.pack(">QqB", start + len(raw), 0, 0)

        for b in batches:
            for start, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reader = wal.Reader(start)
                out = [r for lsn, part in replication.received(messages(start, raw)) for r in reader.feed(lsn, part)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["lsn", "record"])

    parsed = staged(records.parsed(event_log(spark, sf).mapInArrow(run, "lsn long, record binary")), "parsed")
    return parsed.where("error is null").groupBy(F.coalesce("operation", F.lit("outcome")).alias("operation")).agg(F.count("*").alias("n"))
