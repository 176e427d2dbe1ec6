"""Queries of the value, page and log operators: what is written must read back as its source."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.codec import files, heap, wal
from pagelake.codec.heap import Column
from pagelake.functions import register as R
from pagelake.operators import catalog, changelog, pages, records, transactions, visibility
from pagelake.plans.registry import register
from pagelake.session import staged, table
from pagelake.sources import files as sources

CUSTOMER = [Column("c_custkey", "int8"), Column("c_name", "text"), Column("gone", "", True, 4, 4), Column("c_nationkey", "int4"), Column("c_acctbal", "float8"), Column("c_mktsegment", "text")]


@register("numeric_roundtrip", "select o_orderkey, cast(cast(o_totalprice as decimal(18, 2)) as varchar) as price, case when o_orderkey % 2 = 0 then '' else '-' end || '0.000' || (o_orderkey + 1) as small from orders")
def numeric_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    small = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("-"), F.lit("0.000"), (F.col("o_orderkey") + 1).cast("string"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), small.alias("small"))
    return o.select("o_orderkey", R.function("pg_numeric_text")(R.function("pg_numeric_bytes")("price")).alias("price"), R.function("pg_numeric_text")(R.function("pg_numeric_bytes")("small")).alias("small"))


@register("jsonb_roundtrip", "select event_id, props from events")
def jsonb_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", R.function("pg_jsonb_text")(R.function("pg_jsonb_bytes")("props")).alias("props"))


def customer_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumns({"rel": F.lit(16384).cast("long"), "block": F.expr("c_custkey div 60"), "slot": (F.col("c_custkey") % 60 + 1).cast("int"), "xmin": F.lit(700).cast("long"), "xmax": F.lit(0).cast("long")})
    return pages.build(c, CUSTOMER)


@register("page_roundtrip_customer", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def page_roundtrip_customer(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.decode(pages.tuples(customer_pages(spark, sf)), CUSTOMER)
    return rows.where("decode_error is null").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("page_checksums_valid", "select c_custkey // 60 as block, true as valid from customer group by 1")
def page_checksums_valid(spark: SparkSession, sf: str) -> DataFrame:
    return pages.verified(customer_pages(spark, sf)).select("block", "valid")


@register("relation_blocks", "select 16384 as rel, max(c_custkey // 60) + 1 as n_blocks from customer")
def relation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return pages.block_counts(customer_pages(spark, sf))


PAIR = [Column("k", "int8"), Column("v", "int4")]


def chain_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of twenty customers, each updated in place up to three times."""
    groups = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 20").alias("block"))

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        slots, block = [], int(key[0])
        for k in sorted(int(k) for k in group["k"]):
            n = k % 4
            for v in range(n + 1):
                here, more = len(slots) + 1, v < n
                xid = lambda v: 10 + k * 4 + v  # noqa: B023, E731
                flags = (heap.HOT_UPDATED if more else 0) | (heap.HEAP_ONLY if v else 0)
                slots.append(("tuple", heap.make_tuple(PAIR, [k, v], xid(v), xid(v + 1) if more else 0, (block, here + 1 if more else here), flags=flags)))
        return pd.DataFrame({"rel": [1], "block": [block], "page": [heap.build_page(slots, block, 1)]})

    return groups.groupBy("block").applyInPandas(make, "rel long, block long, page binary")


@register(
    "hot_chain_emit",
    """with versions as (select c_custkey as k, unnest(range(c_custkey % 4 + 1))::int as v, c_custkey % 4 as n from customer),
    judged as (select k, v, (10 + k * 4 + v) % 5 <> 0 as inserted, v < n and (11 + k * 4 + v) % 5 <> 0 as deleted from versions)
    select k, v from judged where inserted and not deleted qualify row_number() over (partition by k order by v) = 1""",
)
def hot_chain_emit(spark: SparkSession, sf: str) -> DataFrame:
    """Each fifth transaction aborted; the visible version of each chain."""
    xid = F.explode(F.expr("sequence(10 + c_custkey * 4, 10 + c_custkey * 4 + c_custkey % 4)")).alias("xid")
    status = table(spark, sf, "customer").select("c_custkey").distinct().select(xid).select("xid", F.when(F.col("xid") % 5 == 0, "aborted").otherwise("committed").alias("status"))
    return pages.decode(pages.visible(chain_pages(spark, sf), status), PAIR).select("k", "v")


def class_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as pg_class tuples; each fourth is deleted, by a transaction that each second time aborted."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.expr("s_suppkey div 30").alias("block"))

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        slots = []
        for r in group.sort_values("s_suppkey").to_dict("records"):
            k = int(r["s_suppkey"])
            attrs = files.class_bytes(16384 + k, r["s_name"], 2200, 20000 + k, 0, "r" if k % 5 else "i", 3)
            slots.append(("tuple", heap.raw_tuple(100, 200 + k % 8 if k % 4 == 0 else 0, (int(key[0]), len(slots) + 1), 33, 0 if k % 4 == 0 else heap.XMAX_INVALID, b"", attrs)))
        return pd.DataFrame({"rel": [1259], "block": [int(key[0])], "page": [heap.build_page(slots, int(key[0]), 1)]})

    return rows.groupBy("block").applyInPandas(make, "rel long, block long, page binary")


@register("catalog_from_pages", "select s_suppkey + 16384 as oid, s_name as relname, s_suppkey + 20000 as relfilenode from supplier where s_suppkey % 5 <> 0 and (s_suppkey % 4 <> 0 or s_suppkey % 8 = 4)")
def catalog_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of pg_class to visible tuples to tables, without SQL of the source."""
    status = spark.sql("select * from values (100L, 'committed'), (200L, 'committed'), (204L, 'aborted') as t(xid, status)")
    pg_class = sources.catalog_rows(pages.visible(class_pages(spark, sf), status), "pg_class")
    space = spark.sql("select 2200L as oid, 'public' as nspname")
    return catalog.tables(pg_class, space).select("oid", "relname", "relfilenode")


CHUNKED = [Column("doc_id", "int8"), Column("text", "text")]


@register("toast_reassemble", "select doc_id, text from documents")
def toast_reassemble(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts as chunks of 1,996 bytes, which rows point to."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / 1996)).cast("int")
    chunks = d.select(F.col("doc_id").alias("value_id"), "b", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("seq", "i"))
    chunks = chunks.select("value_id", "seq", F.expr("substring(b, i * 1996 + 1, 1996)").alias("data"))
    rows = d.select("doc_id", R.long_row("doc_id", F.octet_length("b")).alias("attrs"), F.lit(2).alias("infomask2"), F.lit(None).cast("binary").alias("bitmap"))
    rows = rows.withColumnRenamed("doc_id", "row")
    return pages.decode(pages.with_chunks(rows, CHUNKED, chunks, ["row"]), CHUNKED).where("decode_error is null").select("doc_id", "text")


EVENT = [Column("event_id", "int8"), Column("user_id", "int8"), Column("event_type", "text")]


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log segments of a thousand transactions each: the events, then their commits or aborts."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("event_id div 7000").alias("segment"))

    def make(group: pd.DataFrame) -> list[bytes]:
        out = []
        for r in group.sort_values("event_id").to_dict("records"):
            i = int(r["event_id"])
            top = i // 7
            xid = top + 1_000_000_000 if i % 3 == 0 else top
            variant = top % 2 == 0
            out.append(wal.log_insert(xid, (1663, 5, 16384), i >> 6, (i & 63) + 1, wal.log_tuple(EVENT, [i, int(r["user_id"]), r["event_type"]], variant), variant))
            if i % 7 == 6:
                out.append(wal.log_outcome(top, top % 5 != 0, [top + 1_000_000_000]))
        return out

    return records.build_segments(e, make)


@register(
    "wal_roundtrip_events",
    """with done as (select event_id // 7 as xid, max(event_id) as lsn from events group by 1 having count(*) = 7 and (event_id // 7) % 5 <> 0),
    log as (select e.*, d.lsn from events e join done d on e.event_id // 7 = d.xid)
    select event_id, user_id, event_type from (select * from log qualify row_number() over (partition by user_id order by lsn desc, event_id desc) = 1) where event_type <> 'error'""",
)
def wal_roundtrip_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to log bytes to records to operations to a change log to current state."""
    parsed = staged(records.parsed(records.framed(event_log(spark, sf))), "parsed")
    tracked = spark.sql("select 16384L as rel")
    ops = transactions.committed(records.operations(parsed, tracked), records.outcomes(parsed))
    rows = pages.decode(transactions.sequenced(ops), EVENT).withColumn("_deleted", F.col("event_type") == "error")
    return changelog.current_state(rows, ["user_id"], meta=True).select("event_id", "user_id", "event_type")


@register("wal_record_counts", "select 'insert' as operation, count(*) as n from events union all select 'outcome', count(*) from (select 1 from events group by event_id // 7 having count(*) = 7)")
def wal_record_counts(spark: SparkSession, sf: str) -> DataFrame:
    parsed = records.parsed(records.framed(event_log(spark, sf)))
    return parsed.where("error is null").groupBy(F.coalesce("operation", F.lit("outcome")).alias("operation")).agg(F.count("*").alias("n"))


@register("wal_update_roundtrip", "select event_id, user_id, event_type from events")
def wal_update_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Each event updates its user's row; the log holds only what differs from the row before."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("user_id") % 8).alias("segment"))

    def make(group: pd.DataFrame) -> list[bytes]:
        out, last = [], {}
        for r in group.sort_values("event_id").to_dict("records"):
            u = int(r["user_id"])
            row = [int(r["event_id"]), u, r["event_type"]]
            full = wal.log_tuple(EVENT, row)
            attrs = heap.encode_attrs(EVENT, row)[1]
            if u not in last:
                out.append(wal.log_insert(1, (1663, 5, 7), u, 1, full))
            else:
                old, flags, data = last[u], wal.SUFFIX, full
                n = 0
                while n < min(len(old), len(attrs)) and old[-1 - n] == attrs[-1 - n]:
                    n += 1
                data = n.to_bytes(2, "little") + full[: len(full) - n]
                out.append(wal.log_update(1, (1663, 5, 7), u, 1, 1, data, flags))
            last[u] = attrs
        return out

    numbers = e.groupBy("segment").agg(F.min("segment").alias("s")).select(F.dense_rank().over(Window.orderBy("s")).alias("n"), "s")  # eight rows at most
    e = e.join(F.broadcast(numbers), F.col("segment") == F.col("s")).select("event_id", "user_id", "event_type", F.col("n").alias("segment"))
    ops = records.operations(records.parsed(records.framed(records.build_segments(e, make))))
    return pages.decode(records.completed(ops), EVENT).where("decode_error is null").select("event_id", "user_id", "event_type")


#: Positions from which events' transactions are numbered here: the first three numbers are special.
FIRST_XID = 3


@register("status_visible_events", "select event_id from events where event_id * 31 % 7 % 4 = 1")
def status_visible_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is written by a transaction of its own, whose status is on a page."""
    from pagelake.plans.lake import status_pages

    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") + FIRST_XID).alias("xmin"), F.lit(0).cast("long").alias("xmax"), F.lit(0).alias("infomask"))
    return visibility.visible(rows, visibility.statuses(status_pages(spark, sf, FIRST_XID))).where("visible").select("event_id")


NULLS = [Column("c_custkey", "int8"), Column("c_name", "text"), Column("gone", "", True, 4, 4), Column("c_nationkey", "int4"), Column("c_acctbal", "float8"), Column("small", "int2"), Column("yes", "bool"), Column("day", "date")]


@register(
    "page_roundtrip_nulls",
    """select c_custkey, case when c_custkey % 7 <> 0 then c_name end as c_name, case when c_custkey % 5 <> 0 then c_nationkey end as c_nationkey, case when c_custkey % 3 <> 0 then c_acctbal end as c_acctbal,
    case when c_custkey % 4 <> 0 then (c_custkey % 100)::smallint end as small, case when c_custkey % 2 = 0 then c_custkey % 6 = 0 end as yes, case when c_custkey % 11 <> 0 then date '1999-12-30' + (c_custkey % 50)::int end as day from customer""",
)
def page_roundtrip_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose tuples have nulls of all kinds, between dead, redirected and unused slots."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 7 != 0, F.col("c_name")).alias("c_name"), F.when(k % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 4 != 0, (k % 100).cast("smallint")).alias("small"), F.when(k % 2 == 0, k % 6 == 0).alias("yes"), F.when(k % 11 != 0, F.date_add(F.lit("1999-12-30").cast("date"), (k % 50).cast("int"))).alias("day"),
        F.lit(16384).cast("long").alias("rel"), F.expr("c_custkey div 40").alias("block"), ((k % 40) * 2 + 1).cast("int").alias("slot"), F.lit(700).cast("long").alias("xmin"), F.lit(0).cast("long").alias("xmax"),
    )
    others = c.where("c_custkey % 4 < 2").select("rel", "block", (F.col("slot") + 1).alias("slot"), F.when(F.col("c_custkey") % 4 == 0, "dead").otherwise("redirect").alias("kind"), F.col("slot").alias("target"))
    rows = pages.decode(pages.tuples(pages.build(c.unionByName(others, allowMissingColumns=True), NULLS)), NULLS)
    return rows.where("decode_error is null").select(*(x.name for x in NULLS if not x.dropped))


@register("relation_block_ranges", "select 16384 as rel, 0 as first, max(c_custkey // 60) as last, max(c_custkey // 60) + 1 as n from customer")
def relation_block_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return pages.block_ranges(customer_pages(spark, sf))


@register("wal_delete_roundtrip", "select event_id, user_id, event_type || '!' as event_type from events where event_type <> 'error' or event_id % 2 = 0")
def wal_delete_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is inserted and updated in place (the log holds what differs); errors are then deleted, of
    which each second deletion is aborted. A delete names only an address: its key comes from the tuple there."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("event_id div 5000").alias("segment"))

    def make(group: pd.DataFrame) -> list[bytes]:
        out, rel = [], (1663, 5, 16384)
        for r in group.sort_values("event_id").to_dict("records"):
            i = int(r["event_id"])
            at, variant = (i >> 6, (i & 63) + 1), i % 3 == 0
            old, new = [i, int(r["user_id"]), r["event_type"]], [i, int(r["user_id"]), r["event_type"] + "!"]
            same = 16
            short = wal.log_tuple(EVENT, new, variant)
            head = len(short) - len(heap.encode_attrs(EVENT, new)[1])
            out.append(wal.log_insert(1, rel, *at, wal.log_tuple(EVENT, old, variant), variant))
            out.append(wal.log_update(1, rel, at[0], at[1], at[1], same.to_bytes(2, "little") + short[:head] + short[head + same :], wal.PREFIX, variant))
            if r["event_type"] == "error":
                out.append(wal.log_delete(3 if i % 2 else 2, rel, *at, variant))
        return [*out, wal.log_outcome(1, True, []), wal.log_outcome(2, False, []), wal.log_outcome(3, True, [])]

    parsed = staged(records.parsed(records.framed(records.build_segments(e, make))), "parsed")
    done = records.outcomes(parsed).groupBy("xid", "committed").agg(F.max("lsn").alias("lsn"), F.lit(None).cast("array<long>").alias("subxids"))
    ops = records.completed(transactions.committed(records.operations(parsed, db=5), done).drop("top_xid", "commit_lsn"))
    again = transactions.sequenced(transactions.committed(pages.decode(ops, EVENT).where("decode_error is null"), done))
    return changelog.current_state(transactions.emitted(again, ["event_id"]), ["event_id"], meta=True).select("event_id", "user_id", "event_type")


@register("ddl_suspects", "select event_id // 7 + 1 as xid, min(event_id) as first_event from events where event_id % 50 = 3 or event_id % 70 = 4 group by 1")
def ddl_suspects(spark: SparkSession, sf: str) -> DataFrame:
    """Some events write to a catalog or make a relation's file, in this database or another one."""
    e = table(spark, sf, "events").select("event_id", F.expr("event_id div 7000").alias("segment"))

    def make(group: pd.DataFrame) -> list[bytes]:
        out = []
        for i in sorted(int(i) for i in group["event_id"]):
            rel = (1663, 5, 1259) if i % 50 == 3 else (1663, 6, 1259) if i % 50 == 4 else (1663, 5, 16384)
            if i % 70 in (4, 5):
                out.append(wal.build(i // 7 + 1, wal.SMGR, wal.SMGR_CREATE, struct.pack("<IIIi", 1663, 5 if i % 70 == 4 else 6, i, 0), []))
            else:
                out.append(wal.log_insert(i // 7 + 1, rel, i, 1, wal.log_tuple(EVENT, [i, 0, ""])))
        return [wal.build(0, wal.SMGR, wal.SMGR_CREATE, struct.pack("<IIIi", 1663, 5, 9, 0), []), *out]

    parsed = staged(records.parsed(records.framed(records.build_segments(e, make))), "parsed")
    found = records.suspects(parsed, 5, spark.sql("select 1259L as rel"))
    # the position of a record tells its event, as both ascend
    places = parsed.where("xid <> 0 or main is not null").where("rmgr <> 0 or xid <> 0")
    ids = places.select("lsn", "xid", F.expr(f"case when operation is not null then blocks[0].block else cast(conv(concat(substring(hex(main), 23, 2), substring(hex(main), 21, 2), substring(hex(main), 19, 2), substring(hex(main), 17, 2)), 16, 10) as bigint) end").alias("first_event"))
    return found.join(ids.drop("xid"), "lsn").select("xid", "first_event")


@register(
    "layer_roundtrip",
    """select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, case when (c_custkey // 60) % 3 = 0 then 'delta' else 'image' end as layer from customer""",
)
def layer_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' pages as values of image and delta layer files with indexes of many levels, among log
    records and entries that state a size."""
    made = customer_pages(spark, sf).withColumn("file", F.col("block") % 3)

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        entries = []
        for block, page in sorted(zip(group["block"], group["page"], strict=True)):
            at = bytes([0]) + struct.pack(">IIIBI", 1663, 5, 16384, 0, int(block))
            if key[0] == 0:
                entries += [(at + struct.pack(">Q", 50), files.record_value(b"log record", False)), (at + struct.pack(">Q", 60), files.image_value(page))]
            else:
                entries.append((at, page))
        size = bytes([0]) + struct.pack(">IIIBI", 1663, 5, 16384, 0, 0xFFFFFFFF)
        entries.append((size + struct.pack(">Q", 60), files.image_value(b"size")) if key[0] == 0 else (size, b"size"))
        return pd.DataFrame({"content": [files.layer_file(entries, 40, 70 if key[0] == 0 else None, fanout=3)]})

    content = made.groupBy("file").applyInPandas(make, "content binary")
    found = sources.layers(content)
    page_rows = sources.layer_pages(found, 5).withColumn("layer", F.when(F.col("lsn") == 60, "delta").otherwise("image"))
    return pages.decode(pages.tuples(page_rows), CUSTOMER).where("decode_error is null").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "layer")


@register("layer_values", "select 'image' as value, count(distinct c_custkey // 60) as n from customer union all select 'record', count(distinct c_custkey // 60) from customer")
def layer_values(spark: SparkSession, sf: str) -> DataFrame:
    """What a delta layer's values are."""
    keys = table(spark, sf, "customer").select(F.expr("c_custkey div 60").alias("block")).distinct()

    def make(group: pd.DataFrame) -> pd.DataFrame:
        entries = []
        for b in sorted(int(b) for b in group["block"]):
            at = bytes([0]) + struct.pack(">IIIBI", 1, 5, 7, 0, b)
            entries += [(at + struct.pack(">Q", 1), files.image_value(bytes(8192))), (at + struct.pack(">Q", 2), files.record_value(b"r" * (b % 300), b % 2 == 0))]
        return pd.DataFrame({"content": [files.layer_file(entries, 1, 3, fanout=4)]})

    content = keys.withColumn("file", F.col("block") % 4).groupBy("file").applyInPandas(make, "content binary")
    return sources.layers(content).groupBy("value").agg(F.count("*").alias("n"))


@register(
    "copy_snapshot_orders",
    """select o_orderkey, case when o_orderkey % 9 <> 0 then o_custkey end as o_custkey, o_orderpriority, cast(cast(o_totalprice as decimal(18, 2)) as varchar) as price, o_orderdate,
    777 as _lsn, ((o_orderkey // 100) << 16) | (o_orderkey % 100 + 1) as _ctid from orders""",
)
def copy_snapshot_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as binary copies with their addresses, read as a snapshot's log rows."""
    cols = [Column("o_orderkey", "int8"), Column("o_custkey", "int8"), Column("o_orderpriority", "text"), Column("price", "numeric"), Column("o_orderdate", "timestamp")]
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 9 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("o_orderdate"),
        F.expr("o_orderkey div 2000").alias("part"),
    )

    def make(key: tuple, group: pa.Table) -> pa.Table:
        rows = [((r["o_orderkey"] // 100, r["o_orderkey"] % 100 + 1), [r[c.name] for c in cols]) for r in group.to_pylist()]
        return pa.table({"content": [files.copy_bytes(rows, [c.type for c in cols])]}, pa.schema([("content", pa.binary())]))

    content = o.groupBy("part").applyInArrow(make, "content binary")
    return sources.copies(content, cols, 777).select(*(c.name for c in cols), "_lsn", "_ctid")


CHUNK = [Column("id", "int8"), Column("body", "text")]


@register("wal_long_values", "select user_id as id, repeat('x' || user_id::varchar, 700) as body, max(event_id) as last from events group by user_id")
def wal_long_values(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first event writes a long value with its chunks; later ones update the row and leave the
    value alone, so the log has a pointer to it and no chunks."""
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") % 8).alias("segment"))

    def make(group: pd.DataFrame) -> list[bytes]:
        out, seen = [], set()
        for r in group.sort_values("event_id").to_dict("records"):
            u, i = int(r["user_id"]), int(r["event_id"])
            size = len(f"x{u}") * 700
            attrs = struct.pack("<q", u) + heap.make_pointer(size + 4, size, u + 1, 9)
            data = struct.pack("<HHB", 2, heap.HAS_EXTERNAL, 24) + b"\0" + attrs
            out.append(wal.log_update(1, (1, 5, 7), u, 1, 1, data) if u in seen else wal.log_insert(1, (1, 5, 7), u, 1, data))
            seen.add(u)
        return out

    numbers = e.groupBy("segment").agg(F.min("segment").alias("s")).select(F.dense_rank().over(Window.orderBy("s")).alias("n"), "s")  # eight rows at most
    e = e.join(F.broadcast(numbers), F.col("segment") == F.col("s")).select("event_id", "user_id", F.col("n").alias("segment"))
    parsed = records.parsed(records.framed(records.build_segments(e, make)))
    ops = staged(records.operations(parsed), "operations")
    first = ops.where("op = 'insert'").select("rel", "lsn", "pos", F.expr("shiftright(ctid, 16)").alias("u"))
    body = F.encode(F.repeat(F.concat(F.lit("x"), F.col("u").cast("string")), 700), "UTF-8")
    chunks = first.select("rel", "lsn", "pos", F.create_map(F.col("u") + 1, body).alias("__chunks"))
    rows = records.carried(pages.decode(ops.join(chunks, ["rel", "lsn", "pos"], "left"), CHUNK, carry=True), CHUNK)
    newest = rows.where("decode_error is null").groupBy("id").agg(F.max_by("body", F.struct("lsn", "pos")).alias("body"), F.count("*").alias("n"))
    last = e.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("last"), F.count("*").alias("m"))
    return newest.join(last, "id").where("n = m").select("id", "body", "last")
