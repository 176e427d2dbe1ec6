"""Files of the log, heap, status, copy and layer formats as DataFrames.

Files are found and read by Spark's binaryFile source, so they may lie in any store it reads; each is
one task's work. read_* give rows; the registered Python data sources serve `spark.read.format(...)`
and, for log segments, `spark.readStream`.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from pagelake.codec import bits, files, heap, wal
from pagelake.codec.heap import Column
from pagelake.operators.pages import batch


def _binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    """make: the columns of a row to output rows."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out = []
                for r in make(*row):
                    out.append(r)
                    if len(out) == 512:
                        yield batch(out, kind)
                        out = []
                yield batch(out, kind)

    return df.mapInArrow(run, kind)


def segment_lsn(name: str, segment: int = wal.SEGMENT) -> int:
    """Start of a log segment by its file name: timeline, high and low number, eight digits each."""
    return (int(name[8:16], 16) * (0x100000000 // segment) + int(name[16:24], 16)) * segment


def segment_name(lsn: int, timeline: int = 1, segment: int = wal.SEGMENT) -> str:
    n, per = lsn // segment, 0x100000000 // segment
    return f"{timeline:08X}{n // per:08X}{n % per:08X}"


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """(start_lsn, bytes) of log segment files, for records.framed()."""
    return _mapped(_binary(spark, path, "[0-9A-F]" * 24), "start_lsn long, bytes binary", lambda name, raw: [(segment_lsn(os.path.basename(name)), raw)])


def read_heap(spark: SparkSession, path: str, segment_blocks: int = 131072) -> DataFrame:
    """heap_pages() of relation files."""
    return heap_pages(_binary(spark, path), segment_blocks)


def heap_pages(content: DataFrame, segment_blocks: int = 131072) -> DataFrame:
    """(rel, block, page) of relation files (path, content), named by their number and, beyond the first, a segment."""

    def pages(name: str, raw: bytes) -> Iterator[tuple]:
        rel, _, segment = os.path.basename(name).partition(".")
        first = int(segment or 0) * segment_blocks
        for i in range(len(raw) // heap.PAGE):
            yield int(rel), first + i, raw[i * heap.PAGE : (i + 1) * heap.PAGE]

    return _mapped(content.select("path", "content"), "rel long, block long, page binary", pages)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """status_pages() of transaction status segments."""
    return status_pages(_binary(spark, path))


def status_pages(content: DataFrame) -> DataFrame:
    """(page_no, page) of status segments (path, content), for visibility.statuses()."""
    return _mapped(content.select("path", "content"), "page_no long, page binary", lambda name, raw: files.segment_pages(os.path.basename(name), raw))


def read_multi_offsets(spark: SparkSession, path: str) -> DataFrame:
    pages = read_status(spark, path)
    return _mapped(pages, "multi long, offset long", lambda n, p: files.multi_offsets(n, p)).where("offset > 0")


def read_multi_members(spark: SparkSession, path: str) -> DataFrame:
    return _mapped(read_status(spark, path), "offset long, xid long, status int", lambda n, p: files.multi_members(n, p)).where("xid > 0")


def read_copy(spark: SparkSession, path: str, columns: list[Column], lsn: int) -> DataFrame:
    """copies() of files."""
    return copies(_binary(spark, path).select("content"), columns, lsn)


def copies(content: DataFrame, columns: list[Column], lsn: int) -> DataFrame:
    """A snapshot in binary copies (one a row) as log rows at one position: the columns, _lsn, _seq, _deleted, _ctid."""
    from pagelake.operators.pages import _shown, _stored

    kinds = [c.type for c in columns]
    schema = ", ".join(f"{c.name} {_stored(c)}" for c in columns) + ", _ctid long"
    rows = _mapped(content, schema, lambda raw: ((*v, a[0] << 16 | a[1]) for a, v in files.copy_rows(raw, kinds)))
    rows = rows.withColumns({c.name: _shown(c) for c in columns if c.type in ("date", "timestamp", "timestamptz")})
    # an address is unique in a snapshot, so it numbers the rows without sorting them
    return rows.withColumns({"_lsn": F.lit(lsn).cast("long"), "_seq": F.col("_ctid"), "_deleted": F.lit(False)})


def layers(content: DataFrame) -> DataFrame:
    """Key parts, lsn, kind of value (image, record or special), will_init and blob of layer files (one a row)."""

    def entries(raw: bytes) -> Iterator[tuple]:
        s = files.layer_summary(raw)
        size = files.KEY if s["image"] else files.KEY + 8
        for key, value in files.layer_entries(raw, s["index"], s["root"], size):
            k = files.layer_key(key[: files.KEY])
            lsn = s["lsns"][0] if s["image"] else int.from_bytes(key[files.KEY :], "big")
            blob = files.layer_blob(raw, value if s["image"] else value >> 1)
            what, blob, whole = ("image", blob, True) if s["image"] else files.layer_value(blob)
            yield k["kind"], k["space"], k["db"], k["rel"], k["fork"], k["block"], lsn, s["image"], what, whole, blob

    return _mapped(content, "kind int, space long, db long, rel long, fork int, block long, lsn long, image boolean, value string, will_init boolean, blob binary", entries)


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """layers() of files."""
    return layers(_binary(spark, path).select("content"))


def layer_pages(entries: DataFrame, db: int | None = None) -> DataFrame:
    """(rel, block, lsn, page) of relation pages among layer entries; what states a relation's size is none."""
    found = entries.where("kind = 0 and fork = 0 and value = 'image' and block <> 4294967295")
    found = found if db is None else found.where(F.col("db") == db)
    return found.select("rel", "block", "lsn", F.col("blob").alias("page"))


def read_relation_map(spark: SparkSession, path: str) -> DataFrame:
    return _mapped(_binary(spark, path), "oid long, relfilenode long", lambda _, raw: files.relation_map(raw).items())


def catalog_rows(tuples: DataFrame, kind: str) -> DataFrame:
    """Rows of pg_class, pg_attribute or pg_index from their visible tuples (attrs)."""
    make, schema = {
        "pg_class": (files.class_row, "oid long, relname string, relnamespace long, relfilenode long, reltoastrelid long, relkind string, relnatts int"),
        "pg_attribute": (files.attribute_row, "attrelid long, attname string, atttypid long, attlen int, attnum int, attalign string, atthasmissing boolean, attisdropped boolean"),
        "pg_index": (files.index_row, "indrelid long, indnkeyatts int, indisprimary boolean, indkey array<int>"),
    }[kind]
    return _mapped(tuples.select("attrs"), schema, lambda a: [tuple(make(a).values())])


# --- Python data sources -------------------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """A partition for each file below the path."""

    def __init__(self, options: dict, make):
        self.path, self.make = options["path"], make

    def partitions(self) -> list[InputPartition]:
        found = glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path)
        return [_File(p) for p in sorted(found) if os.path.isfile(p)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from self.make(os.path.basename(partition.path), f.read())


class _Segment(InputPartition):
    """A segment file, and those after it, which may hold the end of its last record."""

    def __init__(self, path: str, following: list[str]):
        self.path, self.following = path, following


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _segment_records(part: _Segment) -> Iterator[tuple[int, bytes]]:
    """The records that begin in a segment. A last one that the files don't end isn't there yet."""
    start, raw = segment_lsn(os.path.basename(part.path)), _content(part.path)
    reader = wal.Reader(start)
    yield from reader.feed(start, raw)
    if reader.record_lsn is None:
        return
    record, end = bytes(reader.record), start + len(raw)
    for path in part.following:
        if len(record) >= reader.total:
            break
        if (lsn := segment_lsn(os.path.basename(path))) != end:
            raise wal.FormatError(f"a gap: {lsn:X} in place of {end:X}")
        raw = _content(path)
        record, end = record + wal.head(raw, lsn), lsn + len(raw)
    if len(record) >= reader.total:
        yield reader.record_lsn, record[: reader.total]


def _segments(path: str) -> list[str]:
    names = sorted(n for n in os.listdir(path) if len(n) == 24)
    lsns = [segment_lsn(n) for n in names]
    if lsns and lsns != list(range(lsns[0], lsns[0] + len(lsns) * wal.SEGMENT, wal.SEGMENT)):
        raise wal.FormatError("a segment is missing")
    return [os.path.join(path, n) for n in names]


class _WalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        found = _segments(self.path)
        return [_Segment(p, found[i + 1 :]) for i, p in enumerate(found)]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        return _segment_records(partition)


class WalSource(DataSource):
    """format("pagelake_wal"): (lsn, record) of segment files on a path that all executors see. A task reads a
    segment and, as far as its last record needs it, the ones after it.

    As a stream, a segment is read once, when all records that begin in it have ended."""

    @classmethod
    def name(cls) -> str:
        return "pagelake_wal"

    def schema(self) -> str:
        return "lsn bigint, record binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WalReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _WalStream(self.options)


class _WalStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.start = options["path"], options.get("start", "")

    def initialOffset(self) -> dict:
        return {"after": self.start}

    def latestOffset(self) -> dict:
        """The newest segment whose last record has ended: all before the first that is still open."""
        found = [p for p in _segments(self.path) if os.path.basename(p) > self.start]
        while found and self._open(found[-1]):
            found.pop()
        return {"after": os.path.basename(found[-1]) if found else self.start}

    @staticmethod
    def _open(path: str) -> bool:
        start = segment_lsn(os.path.basename(path))
        reader = wal.Reader(start)
        for _ in reader.feed(start, _content(path)):
            pass
        return reader.record_lsn is not None or reader.skip > 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = _segments(self.path)
        return [_Segment(p, found[i + 1 :]) for i, p in enumerate(found) if start["after"] < os.path.basename(p) <= end["after"]]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        return _segment_records(partition)


class HeapSource(DataSource):
    """format("pagelake_heap"): (block, page) of relation files."""

    @classmethod
    def name(cls) -> str:
        return "pagelake_heap"

    def schema(self) -> str:
        return "rel bigint, block bigint, page binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, lambda name, raw: ((int(name.split(".")[0]), i, raw[i * bits.PAGE : (i + 1) * bits.PAGE]) for i in range(len(raw) // bits.PAGE)))


class StatusSource(DataSource):
    """format("pagelake_status"): (page_no, page) of status segments."""

    @classmethod
    def name(cls) -> str:
        return "pagelake_status"

    def schema(self) -> str:
        return "page_no bigint, page binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, files.segment_pages)


def register(spark: SparkSession) -> None:
    for source in (WalSource, HeapSource, StatusSource):
        spark.dataSource.register(source)
