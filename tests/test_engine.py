"""Codecs, operators, tables and streams on small cases."""

import datetime
import json
import os
import random
import struct
import time
import types
import urllib.error
import urllib.request

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__
from pagelake import session
from pagelake.codec import bits, files, heap, values, wal
from pagelake.codec.heap import Column
from pagelake.functions import register as functions
from pagelake.operators import catalog, changelog, pages, records, timetravel, transactions, visibility
from pagelake.plans import registry
from pagelake.session import release, staged
from pagelake.sources import files as sources
from pagelake.sources import replication
from pagelake.sources.commitlog import Conflict, LakeTable
from pagelake.streaming import transactions as transactions_stream
from pagelake.streaming.events import Config, Engine, Event, Tracked
from pagelake.streaming.tail import TailStore, serve

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


# --- values --------------------------------------------------------------------------------------

NUMERICS = ["0", "1", "-1", "10", "100", "1000", "10000", "12345.6789", "-12345.6789", "0.0001", "0.00000001", "123456789.987654321", "99999999999999.99999", "0.10", "5.000", "1234500000000"]


@pytest.mark.parametrize("text", [*NUMERICS, "NaN", "Infinity", "-Infinity"])
@pytest.mark.parametrize("short", [True, False])
def test_numeric_round_trip(text, short):
    assert values.numeric_text(values.numeric_bytes(text, short=short)) == text
    assert values.numeric_text_of_copy(values.numeric_copy_bytes(text)) == text


def test_numeric_literals():
    assert values.numeric_text(bytes.fromhex("01000000d2048813")) == "1234.5"
    assert values.numeric_text(bytes.fromhex("00800500")) == "5"
    assert values.numeric_text_of_copy(bytes.fromhex("000200000000000104d21388")) == "1234.5"
    assert values.numeric_text(values.numeric_bytes("-0.00")) == "0.00"
    for bad in ("", "-", "1.2.3", "1e5", "abc", "."):
        with pytest.raises(values.FormatError):
            values.numeric_bytes(bad)


@given(st.decimals(allow_nan=False, allow_infinity=False, places=7))
@settings(max_examples=200, deadline=None)
def test_numeric_of_any_decimal(d):
    text = f"{d:f}"
    want = text.lstrip("-") if float(d) == 0 else text
    assert values.numeric_text(values.numeric_bytes(text)) == want


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=8), lambda x: st.lists(x, max_size=40) | st.dictionaries(st.text(max_size=5), x, max_size=6), max_leaves=60)


@given(JSON)
@settings(max_examples=150, deadline=None)
def test_jsonb_of_any_value(value):
    assert json.loads(values.jsonb_text(values.jsonb_bytes(json.dumps(value)))) == value


def test_jsonb_text_is_canonical():
    for text in ('{"a": 1}', '[true, "x", null]', "42", '{"b": {"c": [1, 2.50, {}]}, "dd": []}', '"a\\"b\\nc\\u0001é"'):
        assert values.jsonb_text(values.jsonb_bytes(text)) == text
    assert values.jsonb_text(values.jsonb_bytes('{"bb":1,"a":2,"a":3}')) == '{"a": 3, "bb": 1}'
    with pytest.raises(values.FormatError):
        values.jsonb_text(values.jsonb_bytes("[" * 220 + "]" * 220))
    with pytest.raises(values.FormatError):
        values.jsonb_text(b"\x05\0\0\x20")


def test_times():
    assert values.days(0) == 10_957 and values.days(2**31 - 1) is None
    assert values.micros(0) == 946_684_800_000_000 and values.micros(-(2**63)) is None


# --- checksums and compression -------------------------------------------------------------------


def test_crc32c_known_values():
    assert [hex(x) for x in bits.crc32c([b"123456789", b"", b"\0" * 32, b"\xff" * 32])] == ["0xe3069283", "0x0", "0x8a9136aa", "0x62a8ab43"]


def test_page_checksum_sees_every_byte_and_block():
    page = bytearray(random.Random(1).randbytes(8192))
    first = int(bits.page_checksums([bytes(page)], [5])[0])
    assert 1 <= first <= 65535 and int(bits.page_checksums([bytes(page)], [6])[0]) != first
    page[8:10] = b"\1\2"
    assert int(bits.page_checksums([bytes(page)], [5])[0]) == first
    page[4000] ^= 1
    assert int(bits.page_checksums([bytes(page)], [5])[0]) != first


def test_decompression():
    data = bytes(range(256)) * 9
    assert bits.pglz(bits.pglz_literals(data), len(data)) == data
    assert bits.pglz(bytes([0b00000010]) + b"a" + bytes([0x0F, 0x01, 200]), 219) == b"a" * 219
    for codec, name in ((bits.lz4, "lz4_raw"), (bits.zstd, "zstd")):
        assert codec(pa.Codec(name).compress(data).to_pybytes(), len(data)) == data
        with pytest.raises(values.FormatError):
            codec(pa.Codec(name).compress(data).to_pybytes(), len(data) + 1)
    for bad in (bytes([1, 0x00, 0x05]), bytes([1, 0x00]), bits.pglz_literals(b"abc")):
        with pytest.raises(values.FormatError):
            bits.pglz(bad, 10)


# --- tuples and pages ----------------------------------------------------------------------------

FUZZ = [Column("a", "int4"), Column("b", "text"), Column("c", "int8"), Column("d", "bool"), Column("gone", "", True, -1, 4), Column("e", "bytea"), Column("f", "numeric"), Column("g", "uuid"), Column("h", "float8"), Column("i", "int2")]


def fuzz_row(rnd):
    maybe = lambda v: None if rnd.random() < 0.2 else v
    return [
        rnd.randrange(-(2**31), 2**31), maybe("x" * rnd.randrange(130)), maybe(rnd.randrange(-(2**63), 2**63)), maybe(rnd.random() < 0.5), maybe(rnd.randbytes(rnd.randrange(200))),
        maybe(rnd.choice(NUMERICS)), maybe("01234567-89ab-cdef-0123-456789abcdef"), maybe(rnd.random()), maybe(rnd.randrange(-(2**15), 2**15)),
    ]


def test_random_pages_read_back():
    rnd, survived = random.Random(0x9E3779B9), 0
    for _ in range(300):
        slots, want = [], {}
        for i in range(rnd.randrange(1, 29)):
            kind = rnd.choice(["tuple", "tuple", "unused", "dead"])
            if kind == "tuple":
                want[i + 1] = fuzz_row(rnd)
                slots.append(("tuple", heap.make_tuple(FUZZ, want[i + 1], 100, 0, (12, i + 1))))
            else:
                slots.append((kind,))
        page = heap.build_page(slots, 12, 77)
        got = {t.offset: heap.decode_attrs(FUZZ, t.natts, t.bitmap, t.attrs) for t in heap.tuples(page)}
        assert got == want and heap.page_lsn(page) == 77
        assert int(bits.page_checksums([page], [12])[0]) == struct.unpack_from("<H", page, 8)[0]
        survived += 1
    assert survived == 300


def test_tuples_with_fewer_or_more_columns():
    old, new = FUZZ[:2], [*FUZZ[:2], Column("later", "int8")]
    bitmap, attrs = heap.encode_attrs(old, [1, "x"])
    assert heap.decode_attrs(new, 2, bitmap, attrs) == [1, "x", None]
    with pytest.raises(heap.SchemaDrift):
        heap.decode_attrs(old, 3, *heap.encode_attrs(new, [1, "x", 2]))
    assert heap.encode_attrs(old, [1, "y" * 127], long=False) is None


def test_long_and_compressed_values():
    cols, text = [Column("id", "int4"), Column("t", "text")], "long " * 180
    raw = text.encode()
    for method, body in ((0, bits.pglz_literals(raw)), (1, pa.Codec("lz4_raw").compress(raw).to_pybytes())):
        inline = struct.pack("<II", (len(body) + 8) << 2 | 2, len(raw) | method << 30) + body
        assert heap.decode_attrs(cols, 2, b"", struct.pack("<i", 1) + inline) == [1, text]
        stored = struct.pack("<I", len(raw) | method << 30) + body
        pointer = heap.make_pointer(len(raw) + 4, len(stored), 9, 8, method)
        assert heap.decode_attrs(cols, 2, b"", struct.pack("<i", 1) + pointer, lambda p, s=stored: s) == [1, text]
    pointer = struct.pack("<i", 1) + heap.make_pointer(904, 900, 9, 8)
    assert heap.decode_attrs(cols, 2, b"", pointer, lambda p: raw) == [1, text]
    assert heap.decode_attrs(cols, 2, b"", pointer, lambda p: None, old=[0, "old"]) == [1, "old"]
    with pytest.raises(values.FormatError):
        heap.decode_attrs(cols, 2, b"", pointer, lambda p: None)


def test_chains_end_at_cycles_and_reused_slots():
    cols = [Column("a", "int4")]
    make = lambda v, xmin, xmax, to, flags: ("tuple", heap.make_tuple(cols, [v], xmin, xmax, (0, to), flags=flags))
    page = heap.build_page([("redirect", 2), make(1, 10, 11, 3, heap.HEAP_ONLY | heap.HOT_UPDATED), make(2, 11, 12, 4, heap.HEAP_ONLY | heap.HOT_UPDATED), make(3, 99, 0, 4, heap.HEAP_ONLY), make(4, 5, 5, 5, heap.HOT_UPDATED)], 0, 1)
    assert heap.roots(page) == [(1, 2), (5, 5)]
    assert [t.offset for t in heap.chain(page, 2)] == [2, 3]
    assert [t.offset for t in heap.chain(page, 5)] == [5]
    with pytest.raises(values.FormatError):
        heap.build_page([("tuple", bytes(5000)), ("tuple", bytes(5000))], 0, 1)


# --- log -----------------------------------------------------------------------------------------

PAIR = [Column("id", "int4"), Column("t", "text")]
REL = (1663, 5, 16384)


def sealed(sizes, variant=False):
    return wal.seal([wal.log_insert(700 + i, REL, i // 50, i % 50 + 1, wal.log_tuple(PAIR, [i, "x" * n], variant), variant) for i, n in enumerate(sizes)])


@pytest.mark.parametrize("start", [0x3000000, 0x3000000 + 3 * 8192, 5 * wal.SEGMENT])
@pytest.mark.parametrize("step", [5, 7, 8191, 10**9])
def test_framing_in_any_chunks(start, step):
    recs = sealed([100, 12_000, 8_131, 8_971, 0, 3])
    raw, places = wal.frame(recs, start)
    reader, got = wal.Reader(start), []
    for i in range(0, len(raw), step):
        got += reader.feed(start + i, raw[i : i + step])
    assert got == list(zip(places, recs, strict=True))


def test_framing_joins_mid_stream_and_refuses_gaps_and_other_pages():
    recs = sealed([12_000, 50, 9_000, 20])
    raw, places = wal.frame(recs, 0x3000000)
    got = list(wal.Reader(0x3002000).feed(0x3002000, raw[8192:]))
    assert got == [(p, r) for p, r in zip(places, recs, strict=True) if p >= 0x3002000]
    with pytest.raises(values.FormatError):
        list(wal.Reader(0).feed(8, b"x"))
    with pytest.raises(values.FormatError):
        list(wal.Reader(0).feed(0, b"\x12\x34" + bytes(60)))


@pytest.mark.parametrize("variant", [False, True])
def test_records_parse_in_both_dialects(variant):
    raw = sealed([10], variant)[0]
    r = wal.parse(raw)
    assert (r.operation, r.variant, r.blocks[0].relation, wal.insert_offset(r.main)) == ("insert", variant, REL, 1)
    _, _, bitmap, attrs = wal.inserted(r.blocks[0].data, variant)
    assert heap.decode_attrs(PAIR, 2, bitmap, attrs) == [0, "x" * 10]
    broken = bytearray(raw)
    broken[-1] ^= 1
    with pytest.raises(values.FormatError):
        wal.parse(bytes(broken))
    assert wal.crc_ok([raw, bytes(broken)]) == [True, False]
    upd = wal.parse(wal.seal([wal.log_update(1, REL, 4, 2, 9, b"", 0x60, variant)])[0])
    assert wal.update_offsets(upd.main, variant) == (2, 0x60, 9)
    assert wal.delete_offset(wal.parse(wal.seal([wal.log_delete(1, REL, 4, 7, variant)])[0]).main) == 7


def test_operations_are_numbered_by_dialect():
    op = lambda rmgr, info: wal.Record(1, rmgr, info, (), b"").operation
    assert [op(10, 0x40), op(134, 0x30), op(134, 0x40), op(9, 0x50), op(134, 0x50), op(10, 0x80)] == ["update", "update", None, "multi_insert", "multi_insert", "insert"]


def test_page_images_restore():
    page = b"".join(struct.pack("<H", i // 64) for i in range(4096))
    page = page[:2000] + bytes(1600) + page[3600:]
    short = page[:2000] + page[3600:]
    for kind, raw in ((0, short), (wal.IMAGE_PGLZ, bits.pglz_literals(short)), (wal.IMAGE_LZ4, pa.Codec("lz4_raw").compress(short).to_pybytes()), (wal.IMAGE_ZSTD, pa.Codec("zstd").compress(short).to_pybytes())):
        rec = wal.seal([wal.build(1, 10, 0, b"\1\0\0", [(REL, 3, b"", (raw, 2000, 1600, wal.IMAGE_HOLE | kind))])])[0]
        assert wal.parse(rec).blocks[0].image.restore() == page


def test_updates_share_both_ends():
    old, new = (heap.encode_attrs(PAIR, [1, t])[1] for t in ("hello", "hexlo"))
    data = struct.pack("<HH", 7, 2) + struct.pack("<HHB", 2, 0, 24) + b"\0" + new[7:-2]
    assert wal.updated(data, wal.PREFIX | wal.SUFFIX, False, old)[3] == new
    with pytest.raises(values.FormatError):
        wal.updated(data, wal.PREFIX | wal.SUFFIX, False, None)


@pytest.mark.parametrize("variant", [False, True])
def test_multi_inserts_and_images_become_operations(spark, variant):
    def sub(row):
        bitmap, attrs = heap.encode_attrs(PAIR, row)
        start = heap.align(heap.TUPLE_HEADER + len(bitmap), 8)
        body = bitmap.ljust(start - heap.TUPLE_HEADER, b"\0") + attrs
        return struct.pack("<HHHB", len(body), 2, heap.HAS_NULL if bitmap else 0, start) + body

    data = b""
    for row in ([1, "a"], [2, None], [3, "ccc"]):
        data = data.ljust(heap.align(len(data), 2), b"\0") + sub(row)
    rmgr = wal.VARIANT if variant else wal.HEAP2
    main = struct.pack("<BBH", 0, 0, 3) + (bytes(4) if variant else b"") + struct.pack("<3H", 4, 6, 9)
    page = heap.build_page([("unused",), ("tuple", heap.make_tuple(PAIR, [7, "image"], 5, 0, (8, 2)))], 8, 1)
    update = struct.pack("<IHBB", 5, 1, 0, 0) + (bytes(4) if variant else b"") + struct.pack("<IH", 0, 2)
    recs = [
        wal.build(1, rmgr, 0x50, main, [(REL, 8, data, None)]), wal.build(1, rmgr, 0x50 | wal.INIT_PAGE, main[:4], [(REL, 9, data, None)]),
        wal.build(1, wal.VARIANT if variant else wal.HEAP, 0x20, update, [(REL, 8, b"", (page, 0, 0, 0))]), wal.log_delete(1, REL, 8, 2, variant), wal.log_insert(1, (1, 2, 99), 0, 1, wal.log_tuple(PAIR, [0, "other"], variant), variant),
    ]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(wal.seal(recs))], "lsn long, record binary")
    ops = records.operations(records.parsed(df), spark.sql("select 16384L as rel"))
    got = {(r.lsn, r.pos): (r.op, r.ctid, r.old_ctid) for r in ops.collect()}
    at = lambda b, o: b << 16 | o
    assert got == {
        (0, 0): ("insert", at(8, 4), None), (0, 1): ("insert", at(8, 6), None), (0, 2): ("insert", at(8, 9), None), (1, 0): ("insert", at(9, 1), None), (1, 1): ("insert", at(9, 2), None), (1, 2): ("insert", at(9, 3), None),
        (2, 0): ("update", at(8, 2), at(8, 1)), (3, 0): ("delete", None, at(8, 2)),
    }
    rows = pages.decode(ops.where("op <> 'delete'"), PAIR).collect()
    assert {(r.lsn, r.pos): (r.id, r.t) for r in rows} == {(0, 0): (1, "a"), (0, 1): (2, None), (0, 2): (3, "ccc"), (1, 0): (1, "a"), (1, 1): (2, None), (1, 2): (3, "ccc"), (2, 0): (7, "image")}


def test_outcomes_and_created_relations():
    r = wal.parse(wal.seal([wal.log_outcome(9, False, [10, 11])])[0])
    assert (wal.outcome(r), wal.subxacts(r.info, r.main)) == (False, [10, 11])
    assert wal.subxacts(0, bytes(8)) == []
    smgr = lambda fork: wal.Record(0, wal.SMGR, 0x10, (), struct.pack("<IIIi", 1, 2, 3, fork))
    assert wal.created_relation(smgr(0)) == (1, 2, 3) and wal.created_relation(smgr(1)) is None


def test_lost_segments_and_ends_are_refused(spark):
    start = 7 * wal.SEGMENT
    raw, places = wal.frame([*sealed([9_000] * 100), wal.build(1, 1, 0x70, bytes(3 * wal.SEGMENT)), *sealed([50] * 40)], start)
    parts = [(start + i, bytearray(raw[i : i + wal.SEGMENT])) for i in range(0, len(raw), wal.SEGMENT)]
    assert len(parts) == 4
    frame = lambda *which: records.framed(spark.createDataFrame([parts[i] for i in which], "start_lsn long, bytes binary"))
    got = frame(0, 1, 2, 3)
    assert sorted((r.lsn, r.n) for r in got.selectExpr("lsn", "octet_length(record) as n").collect())[99:102] == [(places[99], len(sealed([9_000])[0])), (places[100], len(wal.build(1, 1, 0x70, bytes(3 * wal.SEGMENT)))), (places[101], len(sealed([50])[0]))]
    assert got.count() == len(places)
    assert frame(0, 1, 2).count() == 100 and frame(0).count() == 100  # the newest may end within a record
    for hole in ((0, 2, 3), (0, 1, 3), (0, 1, 1, 2, 3)):
        with pytest.raises(values.FormatError):
            frame(*hole)
    parts[1] = (parts[1][0], parts[1][1][: wal.PAGE * 5])
    with pytest.raises(values.FormatError):
        frame(0, 1, 2, 3)


def test_wal_source_ends_records_in_the_next_segments(spark, tmp_path):
    start = 7 * wal.SEGMENT
    raw, places = wal.frame(sealed([9_000] * 3000), start)
    sources.register(spark)
    names = []
    for i in range(0, len(raw), wal.SEGMENT):
        names.append(tmp_path / sources.segment_name(start + i))
        names[-1].write_bytes(raw[i : i + wal.SEGMENT].ljust(wal.SEGMENT, b"\0"))
    assert len(names) == 2
    got = spark.read.format("pagelake_wal").load(str(tmp_path))
    assert sorted(r.lsn for r in got.select("lsn").collect()) == places and records.parsed(got).where("error is not null").count() == 0
    stream = sources._WalStream({"path": str(tmp_path)})
    assert stream.latestOffset() == {"after": names[1].name}
    names[1].rename(tmp_path / "later")
    assert stream.latestOffset() == {"after": ""}


def test_records_across_segments(spark, tmp_path):
    recs = sealed([9_000] * 4000)
    start = 7 * wal.SEGMENT
    raw, places = wal.frame(recs, start)
    for i in range(0, len(raw), wal.SEGMENT):
        (tmp_path / sources.segment_name(start + i)).write_bytes(raw[i : i + wal.SEGMENT].ljust(wal.SEGMENT, b"\0"))
    assert len(list(tmp_path.iterdir())) == 3
    got = records.framed(sources.read_wal(spark, str(tmp_path)))
    assert sorted(r.lsn for r in got.select("lsn").collect()) == places
    assert records.parsed(got).where("error is not null").count() == 0


# --- files ---------------------------------------------------------------------------------------


def test_status_and_multixact_pages():
    page = bytearray(8192)
    page[190] = 0x65
    assert [files.status(bytes(page), x) for x in (760, 761, 762, 763)] == [1, 1, 2, 1]
    assert files.segment_name(33) == "0001" and [n for n, _ in files.segment_pages("0001", bytes(16384))] == [32, 33]
    offsets = struct.pack("<3I", 0, 1, 3).ljust(8192, b"\0")
    assert list(files.multi_offsets(0, offsets))[:3] == [(0, 0), (1, 1), (2, 3)]
    members = (bytes([0, 0, 4, 0]) + struct.pack("<4I", 0, 768, 769, 0)).ljust(8192, b"\0")
    assert list(files.multi_members(0, members))[1:3] == [(1, 768, 0), (2, 769, 4)]


def test_sources_read_files(spark, tmp_path):
    for d in ("clog", "heap", "copy", "layer", "off"):
        (tmp_path / d).mkdir()
    page = bytearray(8192)
    page[190] = 0x65
    (tmp_path / "clog/0000").write_bytes(bytes(page))
    status = visibility.statuses(sources.read_status(spark, str(tmp_path / "clog")))
    assert {r.xid: r.status for r in status.where("xid between 760 and 763").collect()} == {760: "committed", 761: "committed", 762: "aborted", 763: "committed"}
    (tmp_path / "heap/16384").write_bytes(heap.build_page([("tuple", heap.make_tuple(PAIR, [i, "é"], 3, 0, (0, i))) for i in (1, 2)], 0, 1))
    sources.register(spark)
    for rows in (sources.read_heap(spark, str(tmp_path / "heap")), spark.read.format("pagelake_heap").load(str(tmp_path / "heap"))):
        assert sorted((r.id, r.t) for r in pages.decode(pages.tuples(rows), PAIR).collect()) == [(1, "é"), (2, "é")]
    cols = [Column("id", "int8"), Column("d", "date"), Column("n", "numeric"), Column("j", "jsonb")]
    rows = [((0, 1), [5, 20_000, "1.50", '{"a": 1}']), ((0, 2), [6, None, None, None])]
    (tmp_path / "copy/t").write_bytes(files.copy_bytes(rows, [c.type for c in cols]))
    got = sources.read_copy(spark, str(tmp_path / "copy"), cols, 99).orderBy("id").collect()
    assert [(r.id, r.d, r.n, r.j, r._lsn, r._ctid) for r in got] == [(5, datetime.date(2024, 10, 4), "1.50", '{"a": 1}', 99, 1), (6, None, None, None, 99, 2)]
    entries = [(bytes([0]) + struct.pack(">IIIBI", 1, 2, 3, 0, b), bytes([b % 251]) * (b * 3)) for b in range(300)]
    (tmp_path / "layer/image").write_bytes(files.layer_file(entries, 77, fanout=7))
    (tmp_path / "layer/delta").write_bytes(files.layer_file([(k + struct.pack(">Q", 80), files.record_value(b"w")) for k, _ in entries], 70, 90))
    got = sources.read_layers(spark, str(tmp_path / "layer"))
    assert {(r.block, r.lsn, bytes(r.blob)) for r in got.where("image").collect()} == {(b, 77, v) for b, (_, v) in enumerate(entries)}
    assert got.where("not image and lsn = 80 and value = 'record' and blob = X'77'").count() == 300
    assert files.relation_map(struct.pack("<Ii4I", files.RELMAP_MAGIC, 2, 1259, 700, 1249, 701)) == {1259: 700, 1249: 701}


def test_wal_source_streams_new_segments(spark, tmp_path):
    (tmp_path / "wal").mkdir()
    sources.register(spark)
    counts = []
    for k in (1, 2):
        raw, _ = wal.frame(sealed([50] * 10 * k), k * wal.SEGMENT)
        (tmp_path / "wal" / sources.segment_name(k * wal.SEGMENT)).write_bytes(raw)
        stream = spark.readStream.format("pagelake_wal").load(str(tmp_path / "wal"))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert counts == [10, 30]


def test_catalog_rows_from_pages(spark):
    name = lambda s: s.encode().ljust(64, b"\0")
    cls = struct.pack("<I", 40000) + name("t") + struct.pack("<I", 2200)
    cls = cls.ljust(88, b"\0") + struct.pack("<I", 40005)
    cls = cls.ljust(108, b"\0") + struct.pack("<I", 40010)
    cls = cls.ljust(115, b"\0") + b"r" + struct.pack("<h", 3)
    att = struct.pack("<I", 40000) + name("id") + struct.pack("<Ihh", 23, 4, 1)
    att = att.ljust(87, b"\0") + b"i" + bytes(4) + b"\0\0\0\0"
    idx = struct.pack("<IIhh", 0, 40000, 1, 1).ljust(14, b"\0") + b"\1"
    idx = idx.ljust(40, b"\0") + struct.pack("<i", 1) + bytes(4) + struct.pack("<h", 1)
    rows = lambda a: spark.createDataFrame([(bytearray(a),)], "attrs binary")
    assert tuple(sources.catalog_rows(rows(cls), "pg_class").first()) == (40000, "t", 2200, 40005, 40010, "r", 3)
    assert tuple(sources.catalog_rows(rows(att), "pg_attribute").first())[:5] == (40000, "id", 23, 4, 1)
    assert tuple(sources.catalog_rows(rows(idx), "pg_index").first()) == (40000, 1, True, [1])


def test_replication_messages():
    data = b"w" + struct.pack(">QQq", 100, 200, 0) + b"abc"
    assert replication.message(data) == replication.Data(100, 200, b"abc")
    keep = b"k" + struct.pack(">QqB", 300, 0, 1)
    assert replication.message(keep) == replication.Keepalive(300, True)
    assert list(replication.received(iter([data, keep]))) == [(100, b"abc")]
    assert replication.start_command(0x1_00000010, "s", 1) == "START_REPLICATION SLOT s PHYSICAL 1/10 TIMELINE 1"
    assert replication.system_row(["1", "2", "0/30", None]) == (2, 0x30)
    assert replication.acknowledge(9, 5)[1:25] == struct.pack(">QQQ", 9, 5, 5)

    class Broken:
        def page(self, *_):
            raise ConnectionResetError

    calls = []
    assert replication.Oracle(lambda: calls.append(1) or Broken()).page(1, 2, 3) is None and len(calls) == 2

    def refuse():
        calls.append(1)
        raise ConnectionRefusedError

    dead = replication.Oracle(refuse)
    assert dead.page(1, 2, 3) is None and dead.page(1, 2, 3) is None and len(calls) == 3


class Script:
    """A server that answers what it is asked with what the script says."""

    def __init__(self, answers):
        self.answers, self.out, self.sent = list(answers), b"", []

    def write(self, raw):
        self.sent.append(bytes(raw))
        if self.answers:
            answer = self.answers.pop(0)
            self.out += answer(raw) if callable(answer) else answer

    def read(self, n):
        got, self.out = self.out[:n], self.out[n:]
        return got


def msg(tag, body=b""):
    return tag + struct.pack(">I", len(body) + 4) + body


def data_row(*fields):
    return msg(b"D", struct.pack(">H", len(fields)) + b"".join(struct.pack(">i", -1) if f is None else struct.pack(">i", len(f)) + f.encode() for f in fields))


READY = msg(b"Z", b"I")
HELLO = msg(b"R", struct.pack(">I", 0)) + msg(b"S", b"x\0y\0") + READY


def test_connections_log_in_and_ask():
    error = lambda code: msg(b"E", f"SERROR\0C{code}\0Mno\0\0".encode()) + READY
    server = Script([msg(b"R", struct.pack(">I", 3)), HELLO, data_row("7", "2", "1/30", None) + READY, msg(b"N", b"note\0") + READY, error("42710"), error("42501"), data_row("physical", "0/20", "1") + READY, data_row(None, None, None) + READY])
    conn = replication.Connection(server, "u", "d", {"options": "-c x=1"}, "secret")
    assert server.sent[1] == msg(b"p", b"secret\0") and b"replication\0true\0" in server.sent[0] and b"options\0-c x=1\0" in server.sent[0]
    assert conn.identify() == (2, 0x1_00000030)
    assert conn.create_slot("s") and not conn.create_slot("s")
    with pytest.raises(replication.ServerError, match="42501"):
        conn.create_slot("s")
    assert conn.slot_restart("s") == 0x20 and conn.slot_restart("s") is None
    with pytest.raises(replication.ServerError):
        replication.Connection(Script([msg(b"R", struct.pack(">I", 10))]), "u", "d", password="p")


def test_connections_stream_the_log():
    w = msg(b"d", b"w" + struct.pack(">QQq", 8192, 9000, 0) + b"abc")
    k = msg(b"d", b"k" + struct.pack(">QqB", 9000, 0, 1))
    server = Script([HELLO, msg(b"W", b"\0\0\0") + w + k, b""])
    conn = replication.Connection(server, "u", "d")
    got = conn.stream_log(8192, "slot", 1)
    assert next(got) == replication.Data(8192, 9000, b"abc") and next(got) == replication.Keepalive(9000, True)
    assert server.sent[1] == msg(b"Q", b"START_REPLICATION SLOT slot PHYSICAL 0/2000 TIMELINE 1\0")
    conn.acknowledge(9000, 8192)
    assert server.sent[2][:6] == b"d" + struct.pack(">I", 38) + b"r"
    with pytest.raises(ConnectionError):
        next(got)


def test_snapshots_are_taken_under_a_lock(spark):
    raw = files.copy_bytes([((0, 1), [5, "a"]), ((0, 2), [6, None])], ["int8", "text"])
    copied = msg(b"H", b"\1\0\0") + msg(b"d", raw[:20]) + msg(b"d", raw[20:]) + msg(b"c") + msg(b"C", b"COPY 2\0") + READY
    server = Script([HELLO, READY, READY, data_row("0/99") + READY, copied, READY])
    lsn, got = replication.take_snapshot(replication.Connection(server, "u", "d"), "t", ["id", 'we"ird'])
    assert (lsn, got) == (0x99, raw) and b"EXCLUSIVE" in server.sent[2] and b'"we""ird"' in server.sent[4] and server.sent[5] == msg(b"Q", b"COMMIT\0")
    rows = sources.copies(spark.createDataFrame([(bytearray(got),)], "content binary"), [Column("id", "int8"), Column("t", "text")], lsn).collect()
    assert sorted((r.id, r.t, r._lsn, r._ctid) for r in rows) == [(5, "a", 0x99, 1), (6, None, 0x99, 2)]
    failing = Script([HELLO, READY, msg(b"E", b"C55P03\0Mno\0\0") + READY, READY])
    with pytest.raises(replication.ServerError):
        replication.take_snapshot(replication.Connection(failing, "u", "d"), "t", ["id"])
    assert failing.sent[-1] == msg(b"Q", b"ROLLBACK\0")
    asks = Script([HELLO, data_row("700") + data_row("701") + data_row(None) + READY, data_row("a.b", "x") + data_row("c.d", "") + READY])
    conn = replication.Connection(asks, "u", "d")
    assert replication.catalog_files(conn) == {700, 701} and replication.settings(conn, ["a.b", "c.d"]) == {"a.b": "x"}


def test_page_servers_answer_what_was_asked(spark):
    page = heap.build_page([("tuple", heap.make_tuple(PAIR, [1, "old"], 3, 0, (4, 1)))], 4, 1)

    def answer(tag, more, number=None):
        def give(raw):
            request = raw[5:]
            echo = request[1:] if number is None else struct.pack(">Q", number) + request[9:]
            return msg(b"d", bytes([tag]) + echo + more)

        return give

    error = lambda raw: msg(b"d", bytes([103]) + raw[6:30] + b"gone\0")
    server = Script([HELLO, answer(100, b"\1"), answer(101, struct.pack(">I", 5)), answer(102, page), error, answer(102, page, 99), answer(101, b"")])
    pages_ = replication.PageServer(replication.Connection(server, "u", "d"), 1663, 5)
    assert pages_.exists(16384, 50) and pages_.blocks(16384, 50) == 5 and pages_.page(16384, 4, 50) == page
    assert server.sent[3][5:] == struct.pack(">BQQQIIIBI", 2, 3, 50, 50, 1663, 5, 16384, 0, 4)
    for _ in range(3):
        with pytest.raises(ConnectionError):
            pages_.page(16384, 4, 50)
    stored = replication.StoredPages({(16384, 0): page, (16384, 2): page})
    assert replication.relation_pages(stored, 16384, 9) == [(16384, 0, page), (16384, 2, page)] and not stored.exists(5, 9)


def test_deletes_and_updates_of_rows_older_than_the_log_take_pages(spark):
    old = heap.encode_attrs(PAIR, [1, "hello"])[1]
    page = heap.build_page([("tuple", heap.make_tuple(PAIR, [1, "hello"], 3, 0, (4, 1))), ("tuple", heap.make_tuple(PAIR, [2, "gone"], 3, 0, (4, 2)))], 4, 1)
    new = wal.log_tuple(PAIR, [1, "help"])
    head = len(new) - len(heap.encode_attrs(PAIR, [1, "help"])[1])
    prefix = 4
    assert heap.encode_attrs(PAIR, [1, "help"])[1][:prefix] == old[:prefix]
    recs = [wal.log_update(1, REL, 4, 1, 1, struct.pack("<H", prefix) + new[:head] + new[head + prefix :], wal.PREFIX), wal.log_delete(1, REL, 4, 2), wal.log_delete(1, REL, 9, 1)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(wal.seal(recs))], "lsn long, record binary")
    ops = records.operations(records.parsed(df))
    blind = pages.decode(records.completed(ops), PAIR).collect()
    assert all(r.decode_error and r.id is None for r in blind) and len(blind) == 3
    stored = {(REL[2], 4): page}
    known = records.from_pages(ops, lambda: replication.Oracle(lambda: replication.StoredPages(stored)))
    rows = {r.lsn: r for r in pages.decode(records.completed(ops, known), PAIR).collect()}
    assert (rows[0].id, rows[0].t, rows[0].op) == (1, "help", "update") and (rows[1].id, rows[1].t, rows[1].op) == (2, "gone", "delete")
    assert rows[2].decode_error and len(rows) == 3


def test_layer_nodes_mark_their_children():
    entries = [(bytes([0]) + struct.pack(">IIIBI", 1, 2, 3, 0, b), b"x") for b in range(100)]
    raw = files.layer_file(entries, 5, fanout=4)
    s = files.layer_summary(raw)
    at = (s["index"] + s["root"]) * files.LAYER_PAGE
    n, level, prefix, suffix = struct.unpack_from(">HBBB", raw, at)
    values_ = raw[at + 5 + prefix + n * suffix :][: 5 * n]
    assert level == 3 and set(values_[::5]) == {0x80}
    assert [k for k, _ in files.layer_entries(raw, s["index"], s["root"], files.KEY)] == [k for k, _ in entries]
    with pytest.raises(values.FormatError):
        files.layer_value(struct.pack(">I", 9))
    assert files.layer_value(files.record_value(b"abc", True)) == ("record", b"abc", True) and files.layer_value(files.image_value(b"p")) == ("image", b"p", True)


# --- relational operators ------------------------------------------------------------------------


def test_ranking_comes_before_tombstones(spark):
    log = spark.createDataFrame([(1, "a", 10, 0, False), (1, "a", 20, 0, True), (2, "b", 10, 1, False), (2, "c", 10, 2, False), (None, "n", 5, 0, False)], "k int, v string, _lsn long, _seq long, _deleted boolean").withColumn("_ctid", F.lit(0).cast("long"))
    assert {(r.k, r.v) for r in changelog.current_state(log, ["k"]).collect()} == {(2, "c"), (None, "n")}
    assert {(r.k, r.v) for r in changelog.as_of(log, ["k"], 15).collect()} == {(1, "a"), (2, "c"), (None, "n")}
    assert changelog.compact(log, ["missing"]).count() == 5
    moved = log.limit(0).withColumn("_old_ctid", F.lit(None).cast("long"))
    assert changelog.mirror(moved).collect() == []


def test_moved_rows_leave_their_old_address(spark):
    log = spark.createDataFrame([(1, 10, 0, False, 5, None), (1, 20, 0, False, 6, 5)], "k int, _lsn long, _seq long, _deleted boolean, _ctid long, _old_ctid long")
    assert [r._ctid for r in changelog.mirror(log).collect()] == [6]


def test_changed_types_are_refused(spark):
    a, b = StructType.fromDDL("x int"), StructType.fromDDL("x string, y int")
    with pytest.raises(TypeError):
        changelog.evolve(a, b)
    with pytest.raises(TypeError):
        changelog.conform(spark.range(1).selectExpr("id as x"), a)
    assert changelog.evolve(a, StructType.fromDDL("y int")).names == ["x", "y"]


def test_key_changes_and_unknown_deletes(spark):
    ops = spark.createDataFrame([("update", 2, 1, 0), ("delete", None, None, 1), ("delete", 3, 3, 2)], "op string, k int, old_k int, _seq long").withColumn("_lsn", F.lit(9))
    got = transactions.emitted(ops, ["k"]).collect()
    assert sorted((r.k, r._seq, r._deleted) for r in got) == [(1, 0, True), (2, 1, False), (3, 5, True)]


TRAVEL = [(1, 0, 10, 100), (1, 0, 10, 300), (1, 10, 20, 200)]


def test_time_travel_cases(spark):
    f = spark.createDataFrame(TRAVEL, "rel long, start long, end long, lsn long")
    asked = [(0, 1, 5, 350), (1, 1, 5, 200), (2, 1, 15, 250), (3, 1, 5, 100), (4, 1, 5, 50), (5, 2, 5, 350), (6, 1, 25, 350)]
    got = timetravel.resolve(spark.createDataFrame(asked, "request long, rel long, block long, read_lsn long"), f, 150)
    assert {r.request: (r.outcome, r.base) for r in got.collect()} == {0: ("serve", 300), 1: ("below_horizon", None), 2: ("serve", 200), 3: ("serve", 100), 4: ("below_horizon", None), 5: ("uncovered", None), 6: ("uncovered", None)}
    ranges = spark.createDataFrame([(0, 1, 0, 20), (1, 1, 5, 5), (2, 1, 0, 21), (3, 1, 0, 10)], "range long, rel long, start long, end long")
    assert {r.range: r.redundant for r in timetravel.image_redundant(ranges, f, 150, 300).collect()} == {0: True, 1: True, 2: False, 3: True}
    assert not timetravel.image_redundant(ranges.where("range = 3"), f, 150, 250).first().redundant
    own = spark.createDataFrame([(1, 5, 6, 500)], "rel long, start long, end long, lsn long")
    asked = spark.createDataFrame([(0, 1, 5, 550), (1, 1, 4, 550), (2, 1, 5, 400)], "request long, rel long, block long, read_lsn long")
    for fallback, last in ((False, ("own", "below_horizon", None)), (True, ("parent", "serve", 300))):
        got = timetravel.branch_resolve(asked, f, 150, own, 300, 300, fallback=fallback)
        assert {r.request: (r["from"], r.outcome, r.base) for r in got.collect()} == {0: ("own", "serve", 500), 1: ("parent", "serve", 300), 2: last}


def test_visibility_scenarios(spark):
    status = spark.createDataFrame([(10, "committed"), (11, "aborted"), (12, "committed"), (13, "sub_committed")], "xid long, status string")
    updaters = spark.createDataFrame([(70, 12), (71, None)], "multi long, updater long")
    cases = [
        (10, 0, 0, True), (11, 0, 0, False), (99, 0, 0, False), (13, 0, 0, False), (10, 12, 0, False), (10, 11, 0, True), (10, 99, 0, True), (10, 12, 0x80, True), (10, 12, 0x800, True),
        (99, 0, 0x300, True), (1, 0, 0, True), (2, 10, 0, False), (10, 70, 0x1000, False), (10, 71, 0x1000, True), (0, 0, 0, False),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, xmin long, xmax long, infomask int, want boolean")
    assert visibility.visible(rows, status, updaters).where("visible <> want").collect() == []
    with pytest.raises(Exception, match="updater"):
        visibility.visible(rows, status).collect()


def test_newest_multixact_is_an_error(spark):
    offsets = spark.createDataFrame([(1, 1), (2, 3)], "multi long, offset long")
    members = spark.createDataFrame([(1, 768, 0), (2, 769, 4)], "offset long, xid long, status int")
    assert [tuple(r) for r in visibility.updaters(offsets, members).collect()] == [(1, 769)]
    with pytest.raises(Exception, match="no end"):
        visibility.updaters(offsets, members, next_multi=3).collect()


def test_long_values_miss_a_chunk(spark):
    chunks = spark.createDataFrame([(1, 0, b"a"), (1, 2, b"c"), (2, 1, b"y"), (2, 0, b"x")], "value_id long, seq int, data binary")
    assert {r.value_id: r.data and bytes(r.data) for r in pages.reassembled(chunks, ["value_id"]).collect()} == {1: None, 2: b"xy"}


# --- tables --------------------------------------------------------------------------------------


def log_rows(spark, *rows):
    return spark.createDataFrame([(k, v, lsn, 0, d, k) for k, v, lsn, d in rows], "k long, v string, _lsn long, _seq long, _deleted boolean, _ctid long")


def open_table(spark, path):
    return LakeTable.open(spark, str(path), StructType.fromDDL("k long, v string"))


def test_table_commits_replays_and_vacuums(spark, tmp_path):
    t = open_table(spark, tmp_path / "t")
    t.append(log_rows(spark, (1, "a", 10, False), (2, "b", 10, False)), {"commit": 10, "restart": 5, "filenode": 3})
    t.append(log_rows(spark, (1, "z", 20, False), (2, None, 20, True)), {"commit": 20, "restart": 6, "filenode": 3})
    assert t.append(log_rows(spark, (9, "again", 20, False)), {"commit": 20}) == 2
    assert t.resume() == {"commit": 20, "restart": 6, "filenode": 3}
    assert [tuple(r) for r in t.current(["k"]).collect()] == [(1, "z")]
    assert {tuple(r) for r in t.as_of(["k"], 15).collect()} == {(1, "a"), (2, "b")}
    assert t.log(1).count() == 2 and t.rows_since_compaction() == 4
    (tmp_path / "t/data/lost.parquet").write_bytes(b"x")
    assert t.compact(["k"]) == (4, 1) and t.rows_since_compaction() == 0
    assert t.compact(["k"]) == (1, 1)
    assert t.resume() == {"commit": 20, "restart": 6, "filenode": 3}
    assert t.vacuum() == []
    lost = t.vacuum(datetime.timedelta(seconds=-5))
    assert "data/lost.parquet" in lost and [tuple(r) for r in t.current(["k"]).collect()] == [(1, "z")]


def test_table_grows_columns_before_data(spark, tmp_path):
    t = open_table(spark, tmp_path / "t")
    t.append(log_rows(spark, (1, "a", 10, False)), {"commit": 10})
    t.append(log_rows(spark, (2, "b", 20, False)).withColumn("w", F.lit(7)).drop("v"), {"commit": 20})
    assert {(r.k, r.v, r.w) for r in t.log().collect()} == {(1, "a", None), (2, None, 7)}
    kinds = [[k for line in (tmp_path / f"t/_delta_log/{v:020d}.json").read_text().splitlines() for k in json.loads(line)] for v in range(4)]
    assert "metaData" in kinds[2] and "add" not in kinds[2] and "add" in kinds[3]
    with pytest.raises(TypeError):
        LakeTable.open(spark, str(tmp_path / "t"), StructType.fromDDL("k string"))


def test_table_id_is_kept_and_checkpoints_stand_for_commits(spark, tmp_path):
    t = open_table(spark, tmp_path / "t")
    first = t.snapshot().meta
    for k in range(23):
        t.append(log_rows(spark, (k % 3, str(k), k, False)), {"commit": k + 1, "restart": k})
    grown = LakeTable.open(spark, str(tmp_path / "t"), StructType.fromDDL("k long, v string, w int"))
    assert {k: grown.snapshot().meta[k] for k in ("id", "createdTime")} == {k: first[k] for k in ("id", "createdTime")}
    assert sorted(p.name[:20] for p in (tmp_path / "t/_delta_log").glob("*.checkpoint.parquet")) == [f"{v:020d}" for v in (10, 20)]
    before = t.snapshot()
    for v in range(20):
        (tmp_path / f"t/_delta_log/{v:020d}.json").unlink()
    again = LakeTable(spark, str(tmp_path / "t"))
    assert again.snapshot() == before and again.resume()["commit"] == 23
    assert {tuple(r)[:2] for r in again.current(["k"]).collect()} == {(0, "21"), (1, "22"), (2, "20")}
    assert again.snapshot(21).version == 21 and again.log(21).count() == 21


def test_two_writers_never_take_one_number(spark, tmp_path):
    a, b = open_table(spark, tmp_path / "t"), open_table(spark, tmp_path / "t")
    with pytest.raises(Conflict):
        a._commit(0, [], "TEST")
    a.append(log_rows(spark, (1, "a", 10, False)), {"commit": 1}, app="a")
    b.append(log_rows(spark, (2, "b", 11, False)), {"commit": 1}, app="b")
    assert a.log().count() == 2 and a.snapshot().version == 2


def test_crash_between_files_and_commit_leaves_no_rows(spark, tmp_path, monkeypatch):
    t = open_table(spark, tmp_path / "t")
    with monkeypatch.context() as m:
        m.setattr(LakeTable, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.append(log_rows(spark, (1, "a", 10, False)), {"commit": 10})
    assert t.log().count() == 0 and t.resume()["commit"] is None
    t.append(log_rows(spark, (1, "a", 10, False)), {"commit": 10})
    assert t.log().count() == 1 and len(t.vacuum(datetime.timedelta(seconds=-5))) >= 1


# --- tail and engine -----------------------------------------------------------------------------


def test_tail_keeps_what_the_lake_lacks():
    now = [0.0]
    t = TailStore(retain_seconds=60, max_rows=5, clock=lambda: now[0])
    rows = lambda n: pa.table({"k": list(range(n))})
    for lsn in (1, 2, 3):
        t.push("t", rows(3), lsn)
    assert t.read("t").num_rows == 9
    t.flushed("t", 2)
    assert t.read("t").num_rows == 3
    assert t.status()["tables"]["t"]["unflushed_rows"] == 3
    now[0] = 100
    assert t.read("t").num_rows == 3
    t.push("t", pa.table({"k": [1], "new": [2]}), 4)
    assert t.read("t").column_names == ["k", "new"] and t.read("t").num_rows == 1


def test_tail_over_http():
    t = TailStore()
    server = serve(t)
    url = f"http://127.0.0.1:{server.server_port}"

    def code(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, method=method)) as r:
                return r.status, r.read(), dict(r.headers)
        except urllib.error.HTTPError as e:
            return e.code, b"", dict(e.headers)

    assert code("/tail/t.parquet")[0] == 204
    t.push("t", pa.table({"k": [1, 2]}), 5)
    t.advance(5)
    status, body, headers = code("/tail/t.parquet?min_lsn=5")
    assert status == 200 and headers["X-Applied-Lsn"] == "5"
    assert pq.read_table(pa.BufferReader(body)).num_rows == 2
    assert code("/tail/t.parquet?min_lsn=9&timeout_ms=50")[0] == 408
    assert code("/other")[0] == 404 and code("/tail/t.parquet", "POST")[0] == 405
    assert code("/tail/t.parquet", "HEAD")[2]["Accept-Ranges"] == "none"
    assert json.loads(code("/status")[1])["tables"]["t"]["tail_rows"] == 2
    server.shutdown()


def test_engine_snapshots_remaps_and_detaches(spark, tmp_path):
    state = {"rows": [(1, "a"), (2, "b")], "lsn": 100}
    snap = lambda t: (state["lsn"], log_rows(spark, *((k, v, state["lsn"], False) for k, v in state["rows"])))
    engine = Engine(spark, snap, Config(compact_rows=3))
    t = Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"])
    engine.attach(t)
    assert t.lake.resume() == {"commit": 100, "restart": 100, "filenode": 7}
    engine.flush(5, log_rows(spark, (2, "c", 110, False)), 110, 105)
    assert {tuple(r) for r in t.lake.current(["k"]).collect()} == {(1, "a"), (2, "c")} and engine.tail.applied_lsn == 110
    state.update(rows=[(3, "n")], lsn=120)
    t.filenode = 8
    engine.remap(t, 115)
    assert {tuple(r) for r in t.lake.current(["k"]).collect()} == {(3, "n")} and t.lake.resume()["filenode"] == 8
    assert engine.gap_check(50) == [] and engine.gap_check(10_000) == ["t"]
    again = Engine(spark, snap)
    again.attach(Tracked(5, "t", 9, open_table(spark, tmp_path / "t"), ["k"]))
    assert again.tables[5].lake.resume()["filenode"] == 9
    engine.detach(5)
    assert engine.tables == {}


def test_gaps_and_lost_records_leave_no_deleted_row(spark, tmp_path):
    state = {"rows": [(1, "a"), (2, "b")], "lsn": 100}
    snap = lambda t: (state["lsn"], log_rows(spark, *((k, v, state["lsn"], False) for k, v in state["rows"])))
    engine = Engine(spark, snap)
    t = Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"])
    engine.attach(t)
    state.update(rows=[(1, "a")], lsn=300)
    assert engine.gap_check(200) == ["t"]
    assert {tuple(r) for r in t.lake.current(["k"]).collect()} == {(1, "a")} and t.lake.resume() == {"commit": 300, "restart": 300, "filenode": 7}
    state.update(rows=[(3, "c")], lsn=400)
    engine.lost(350)
    assert {tuple(r) for r in t.lake.current(["k"]).collect()} == {(3, "c")}


def test_a_remap_that_was_cut_off_is_repeated(spark, tmp_path):
    state = {"rows": [(1, "a")], "lsn": 100}

    def snap(t):
        if state["rows"] is None:
            raise KeyboardInterrupt
        return state["lsn"], log_rows(spark, *((k, v, state["lsn"], False) for k, v in state["rows"]))

    t = Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"])
    engine = Engine(spark, snap)
    engine.attach(t)
    state["rows"] = None
    with pytest.raises(KeyboardInterrupt):
        engine.remap(t, 110)
    assert t.lake.resume()["filenode"] == 0
    state.update(rows=[(2, "b")], lsn=120)
    Engine(spark, snap).attach(Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"]))
    assert {tuple(r) for r in t.lake.current(["k"]).collect()} == {(2, "b")} and t.lake.resume()["filenode"] == 7


def test_engine_flushes_by_the_clock_and_keeps_open_work(spark, tmp_path):
    engine = Engine(spark, lambda t: (50, log_rows(spark, (9, "s", 50, False))), Config(flush_rows=1000, flush_seconds=0.3))
    t = Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"])
    engine.attach(t)
    seen = {}

    def events():
        yield Event("op", 60, 4, 5, "insert", {"k": 4, "v": "open"})
        yield Event("op", 61, 1, 5, "insert", {"k": 1, "v": "a"}, ctid=1 << 16 | 2)
        yield Event("commit", 62, 1)
        end = time.monotonic() + 60
        other = LakeTable(spark, t.lake.path)  # this runs in a thread of its own, beside the engine's
        while (other.resume()["commit"] != 62 or engine.age is not None) and time.monotonic() < end:  # no event comes
            time.sleep(0.1)
        seen.update(other.resume(), pending=engine.pending, age=engine.age)
        yield Event("commit", 70, 4)

    engine.run(events())
    assert seen == {"commit": 62, "restart": 60, "filenode": 7, "pending": 1, "age": None}
    assert {(r.k, r._ctid) for r in t.lake.log().where("k = 1").collect()} == {(1, 1 << 16 | 2)}
    assert t.lake.resume()["restart"] == 70 and t.lake.current(["k"]).count() == 3


def test_engine_writes_tombstones_of_changed_keys(spark, tmp_path):
    engine = Engine(spark, lambda t: (50, log_rows(spark, (9, "s", 50, False))), Config(flush_rows=1000, flush_seconds=1000))
    t = Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"])
    engine.attach(t)
    engine.run([
        Event("op", 60, 1, 5, "update", {"k": 10, "v": "moved"}, old={"k": 9}), Event("op", 61, 1, 5, "insert", {"k": 2, "v": "b"}), Event("op", 62, 1, 5, "update", {"k": 2, "v": "c"}),
        Event("op", 63, 1, 5, "delete", None, ctid=7), Event("commit", 64, 1),
    ])
    assert {tuple(r) for r in t.lake.current(["k"]).collect()} == {(10, "moved"), (2, "c")}
    assert t.lake.log().where("k is null").count() == 0


def test_engine_reads_the_catalog_after_suspects_and_drift(spark, tmp_path):
    state, asked = {"rows": [(1, "a")], "lsn": 100}, []
    snap = lambda t: (state["lsn"], log_rows(spark, *((k, v, state["lsn"], False) for k, v in state["rows"])))
    t = Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"], ["k", "v"])
    fresh = {5: Tracked(5, "t", 8, t.lake, ["k"], ["k", "v"])}
    change = ["rewritten"]

    def read():
        asked.append(1)
        return spark.createDataFrame([(5, "t", "t", change[0])], "oid long, old_name string, new_name string, change string"), fresh

    engine = Engine(spark, snap, Config(flush_seconds=1000), read)
    engine.attach(t)
    state.update(rows=[(2, "b")], lsn=150)
    engine.run([Event("suspect", 110, 3), Event("commit", 111, 4), Event("abort", 112, 5), Event("commit", 115, 6, subxids=(3,))])
    assert len(asked) == 1 and {tuple(r) for r in t.lake.current(["k"]).collect()} == {(2, "b")} and t.lake.resume()["filenode"] == 8
    change[0] = "same"
    state.update(rows=[(3, "c")], lsn=300)
    engine.run([Event("drift", 200, oid=5)])
    assert len(asked) == 2 and {tuple(r) for r in t.lake.current(["k"]).collect()} == {(3, "c")}


def test_a_column_with_a_default_that_came_while_offline(spark, tmp_path):
    open_table(spark, tmp_path / "t").append(log_rows(spark, (1, "a", 10, False)), {"commit": 10, "restart": 10, "filenode": 7})
    wide = LakeTable.open(spark, str(tmp_path / "t"), StructType.fromDDL("k long, v string, w int"))
    assert wide.grown and not LakeTable.open(spark, str(tmp_path / "t"), StructType.fromDDL("k long, v string, w int")).grown
    engine = Engine(spark, lambda t: (30, log_rows(spark, (1, "a", 30, False)).withColumn("w", F.lit(5))))
    engine.attach(Tracked(5, "t", 7, wide, ["k"], fast_defaults=True))
    assert {tuple(r) for r in wide.current(["k"]).collect()} == {(1, "a", 5)}


def test_streams_of_new_checkpoints_are_no_replays(spark, tmp_path):
    rows = "xid long, lsn long, pos int, op string, ctid long, k long, v string, old_k long"
    lake = open_table(spark, tmp_path / "t")
    for n in (1, 2):
        ops = spark.createDataFrame([(n, 10 * n, 0, "insert", 5, n, "new", None), (n, 10 * n + 1, 0, "update", 6, n + 100, "moved", n)], rows)
        outcomes = spark.createDataFrame([(n, 10 * n + 5, True, [])], "xid long, lsn long, committed boolean, subxids array<long>")
        transactions_stream.controlled(ops, outcomes).write.mode("append").parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema("kind string, xid long, lsn long, payload string").parquet(str(tmp_path / f"in{n}"))
        out = transactions_stream.released(stream, "pos int, op string, ctid long, k long, v string, old_k long")
        for _ in range(2):  # the same checkpoint twice: nothing is written again
            transactions_stream.to_lake(out, lake, str(tmp_path / f"cp{n}"), keys=["k"]).awaitTermination()
    assert {tuple(r) for r in lake.current(["k"]).collect()} == {(101, "moved"), (102, "moved")}
    assert lake.log().count() == 6 and {r._ctid for r in lake.log().where("v = 'moved' and not _deleted").collect()} == {6}


def test_chunks_wait_in_the_state_with_their_transaction(spark, tmp_path):
    def pointer(k, value_id, size):
        return bytearray(struct.pack("<q", k) + heap.make_pointer(size + 4, size, value_id, 9))

    ops = spark.createDataFrame([(1, 10, 0, pointer(1, 500, 5), 2), (2, 11, 0, pointer(2, 501, 4), 2)], "xid long, lsn long, pos int, attrs binary, infomask2 int")
    chunks = spark.createDataFrame([(1, 8, 500, 0, bytearray(b"abc")), (1, 9, 500, 1, bytearray(b"de")), (2, 9, 501, 1, bytearray(b"lost"))], "xid long, lsn long, value_id long, seq int, data binary")
    outcomes = spark.createDataFrame([(1, 20, True, []), (2, 21, True, [])], "xid long, lsn long, committed boolean, subxids array<long>")
    transactions_stream.controlled(ops, outcomes, chunks).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, xid long, lsn long, payload string").parquet(str(tmp_path / "in"))
    out = transactions_stream.released(stream, "pos int, attrs binary, infomask2 int", chunks=True)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    rows = pages.decode(spark.read.parquet(str(tmp_path / "out")).withColumn("bitmap", F.lit(None).cast("binary")), [Column("k", "int8"), Column("t", "text")])
    assert {(r.xid, r.k, r.t, r.decode_error is None) for r in rows.collect()} == {(1, 1, "abcde", True), (2, None, None, False)}


def test_engine_runs_events(spark, tmp_path):
    engine = Engine(spark, lambda t: (50, log_rows(spark, (9, "s", 50, False))), Config(flush_rows=3, flush_seconds=1000))
    t = Tracked(5, "t", 7, open_table(spark, tmp_path / "t"), ["k"])
    engine.attach(t)
    op = lambda xid, lsn, kind, k, v: Event("op", lsn, xid, 5, kind, {"k": k, "v": v})
    engine.run([
        op(1, 60, "insert", 1, "a"), op(2, 61, "insert", 2, "x"), op(11, 62, "insert", 3, "sub"), Event("abort", 63, 2), Event("commit", 64, 1, subxids=(11,)),
        op(3, 65, "delete", 1, "a"), op(4, 66, "update", 3, "open"), Event("commit", 67, 3), Event("progress", 70),
    ])
    assert {tuple(r) for r in t.lake.current(["k"]).collect()} == {(9, "s"), (3, "sub")}
    assert engine.tail.applied_lsn == 70 and t.lake.resume()["commit"] == 67
    engine.run([op(4, 71, "insert", 4, "z"), Event("lost", 80), Event("commit", 90, 4)])
    assert 4 not in {r.k for r in t.lake.current(["k"]).collect()} and t.lake.resume()["commit"] == 81
    with pytest.raises(ValueError, match="unknown"):
        engine.run([Event("other")])


# --- queries -------------------------------------------------------------------------------------


def same(got, want):
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    return key(got) == key(want)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert same([[r[c] for c in names] for r in df.collect()], cur.fetchall())


def test_entry_has_columns(spark):
    assert __spark_entry__.entry(spark).columns == ["o_custkey", "o_orderpriority"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_staged_tables_are_released(spark):
    path = staged(spark.range(3), "numbers").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    release(spark)
    assert not os.path.exists(path)


def test_a_cluster_names_its_shared_folder():
    none = types.SimpleNamespace(get=lambda *_: None)
    on = lambda master: types.SimpleNamespace(conf=none, sparkContext=types.SimpleNamespace(getConf=lambda: none, getCheckpointDir=lambda: None, master=master))
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(on(master))


def test_bucketed_tables_join_without_a_shuffle_of_their_rows(spark):
    rows = session.bucketed(spark.range(1000).withColumn("t", F.lit("x")), "numbers", "id")
    marks = spark.range(0, 1000, 3).groupBy("id").agg(F.count("*").alias("n"))
    joined = rows.join(marks.hint("merge"), "id", "left")
    assert joined.where("n = 1").count() == 334 and joined.count() == 1000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    name = session._tables[-1]
    session.release(spark)
    assert not spark.catalog.tableExists(name)


def test_broadcasts_are_checked(spark):
    assert "broadcast" in session.small(spark.range(50), 60)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in session.small(spark.range(50), 40)._jdf.queryExecution().logical().toString().lower()


def test_config_from_environment():
    c = Config.from_env({"PAGELAKE_FLUSH_ROWS": "7", "PAGELAKE_VACUUM_MINUTES": "off", "PAGELAKE_SNAPSHOT": "0", "PAGELAKE_TAIL_SECONDS": "1.5"})
    assert (c.flush_rows, c.vacuum_minutes, c.snapshot, c.tail_seconds, c.compact_rows) == (7, None, False, 1.5, 1_000_000)


def test_descriptor_columns_of_known_types():
    live = {"attname": "a", "atttypid": 23, "attlen": 4, "attalign": "i", "attisdropped": False}
    assert catalog.heap_columns([live, live | {"attname": "x", "attisdropped": True, "attlen": 8, "attalign": "d"}]) == [Column("a", "int4"), Column("x", "", True, 8, 8)]
    with pytest.raises(TypeError, match="type 600"):
        catalog.heap_columns([live | {"atttypid": 600}])


def test_sql_functions(spark):
    functions.register(spark)
    row = spark.sql("select pg_numeric_text(pg_numeric_bytes('1.50')) as n, pg_jsonb_text(pg_jsonb_bytes('{\"a\":[1,null]}')) as j, lsn_text(4294967312) as l").first()
    assert tuple(row) == ("1.50", '{"a": [1, null]}', "1/10")
    page = heap.build_page([("tuple", heap.make_tuple(PAIR, [1, "x"], 3))], 0, 1)
    spark.createDataFrame([(bytearray(page),)], "page binary").createOrReplaceTempView("heap_pages")
    assert [r.xmin for r in spark.sql("select t.xmin from heap_pages, lateral heap_page_tuples(page) t").collect()] == [3]
