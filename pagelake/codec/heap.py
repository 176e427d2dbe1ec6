"""Heap tuples and pages: columns, values by alignment, line pointers, chains, building and reading back."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pagelake.codec import bits, values
from pagelake.codec.values import FormatError

PAGE = bits.PAGE
# Fixed values of the page and tuple layout.
PAGE_HEADER, POINTER, TUPLE_HEADER = 24, 4, 23
UNUSED, NORMAL, REDIRECT, DEAD = range(4)
NATTS, HOT_UPDATED, HEAP_ONLY = 0x07FF, 0x4000, 0x8000
HAS_NULL, HAS_VARWIDTH, HAS_EXTERNAL = 0x0001, 0x0002, 0x0004
XMIN_FROZEN, XMAX_INVALID, XMAX_LOCK_ONLY, XMAX_IS_MULTI = 0x0300, 0x0800, 0x0080, 0x1000
TYPES = {  # name: (type id, length or -1, alignment, format)
    "bool": (16, 1, 1, "B"), "int2": (21, 2, 2, "h"), "int4": (23, 4, 4, "i"), "int8": (20, 8, 8, "q"), "float4": (700, 4, 4, "f"), "float8": (701, 8, 8, "d"),
    "text": (25, -1, 4, ""), "varchar": (1043, -1, 4, ""), "bpchar": (1042, -1, 4, ""), "json": (114, -1, 4, ""), "xml": (142, -1, 4, ""), "bytea": (17, -1, 4, ""),
    "uuid": (2950, 16, 1, ""), "numeric": (1700, -1, 4, ""), "jsonb": (3802, -1, 4, ""), "date": (1082, 4, 4, "i"), "timestamp": (1114, 8, 8, "q"), "timestamptz": (1184, 8, 8, "q"),
}
BY_OID = {oid: name for name, (oid, *_) in TYPES.items()}
SPARK = {
    "bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
}
SHORT = 126
#: Stands for a long value whose chunks are unknown.
UNRESOLVED = object()


class SchemaDrift(FormatError):
    """A tuple with more columns than its table is known to have."""


@dataclass(frozen=True)
class Column:
    """A live column, or (dropped) the place of one whose bytes still have to be walked over."""

    name: str
    type: str = ""
    dropped: bool = False
    length: int = 0
    align: int = 1

    @property
    def spark(self) -> str:
        return SPARK.get(self.type, "string")


@dataclass(frozen=True)
class Pointer:
    """A value that is stored in chunks elsewhere."""

    raw_size: int
    info: int
    value_id: int
    relation: int

    @property
    def size(self) -> int:
        return self.info & 0x3FFFFFFF

    @property
    def method(self) -> int:
        return self.info >> 30


#: Resolves a pointer to its stored bytes, or None if they are unknown.
Toast = Callable[[Pointer], bytes | None]


@dataclass(frozen=True)
class Tuple:
    offset: int
    xmin: int
    xmax: int
    ctid: tuple[int, int]
    infomask2: int
    infomask: int
    bitmap: bytes
    attrs: bytes
    raw: bytes = field(repr=False, default=b"")

    @property
    def natts(self) -> int:
        return self.infomask2 & NATTS


def align(at: int, by: int) -> int:
    return at + -at % by


def toast_bytes(p: Pointer, stored: bytes) -> bytes:
    """The value of a pointer's joined chunks."""
    if len(stored) != p.size:
        raise FormatError(f"{len(stored)} stored bytes in place of {p.size}")
    if p.size == p.raw_size - 4:
        return stored
    return bits.datum(p.method, stored[4:], p.raw_size - 4)


def read_varlena(data: bytes, at: int, toast: Toast | None = None) -> tuple[bytes | Pointer, int]:
    """The value at a place and the place after it. A pointer stays one if it can't be resolved."""
    if at >= len(data):
        raise FormatError("a value is cut off")
    head = data[at]
    if head == 1:
        if len(data) < at + 18 or data[at + 1] != 18:
            raise FormatError("an unknown kind of external value")
        p = Pointer(*struct.unpack_from("<iIII", data, at + 2))
        stored = toast(p) if toast else None
        return (p if stored is None else toast_bytes(p, stored)), at + 18
    if head & 1:
        end = at + (head >> 1)
        if head >> 1 < 1 or end > len(data):
            raise FormatError("a short value is cut off")
        return data[at + 1 : end], end
    at = align(at, 4)
    if at + 4 > len(data):
        raise FormatError("a value is cut off")
    word = struct.unpack_from("<I", data, at)[0]
    end = at + (word >> 2)
    if word >> 2 < 4 or end > len(data):
        raise FormatError("a value is cut off")
    if word & 3 == 2:
        info = struct.unpack_from("<I", data, at + 4)[0]
        return bits.datum(info >> 30, data[at + 8 : end], info & 0x3FFFFFFF), end
    return data[at + 4 : end], end


def _of_varlena(kind: str, raw: bytes) -> object:
    if kind == "bytea":
        return raw
    if kind == "numeric":
        return values.numeric_text(raw)
    if kind == "jsonb":
        return values.jsonb_text(raw)
    return raw.decode("utf-8", "replace")


def _of_fixed(kind: str, data: bytes, at: int) -> object:
    _, size, _, form = TYPES[kind]
    if at + size > len(data):
        raise FormatError("a value is cut off")
    if kind == "uuid":
        return values.uuid_text(data[at : at + 16])
    v = struct.unpack_from("<" + form, data, at)[0]
    return v != 0 if kind == "bool" else values.days(v) if kind == "date" else values.micros(v) if kind.startswith("timestamp") else v


def decode_attrs(columns: list[Column], natts: int, bitmap: bytes, attrs: bytes, toast: Toast | None = None, old: list | None = None) -> list:
    """Values of the live columns. Columns beyond natts are null; a pointer without its chunks takes the
    old row's value (an update left it alone) or is an error."""
    if natts > len(columns):
        raise SchemaDrift(f"{natts} columns where {len(columns)} are known")
    out, at = [], 0
    for i, c in enumerate(columns):
        absent = i >= natts or bool(bitmap) and not bitmap[i >> 3] >> (i & 7) & 1
        value = None
        if not absent:
            size, by = (c.length, c.align) if c.dropped else TYPES[c.type][1:3]
            if size < 0:
                value, at = read_varlena(attrs, at, None if c.dropped else toast)
            else:
                at = align(at, by)
                value = None if c.dropped else _of_fixed(c.type, attrs, at)
                at += size
        if c.dropped:
            continue
        if isinstance(value, Pointer):
            if old is None:
                raise FormatError(f"chunks of value {value.value_id} are unknown")
            value = old[len(out)]
        elif isinstance(value, bytes):
            value = _of_varlena(c.type, value)
        out.append(value)
    return out


def encode_attrs(columns: list[Column], row: list, *, long: bool = True) -> tuple[bytes, bytes] | None:
    """Null bitmap (empty without nulls) and attribute bytes of a row; a dropped column is null.
    None if long is off and a value needs more than a one-byte header, or a column can't be null."""
    data, present, it = b"", [], iter(row)
    for c in columns:
        v = None if c.dropped else next(it)
        present.append(v is not None)
        if v is None:
            continue
        _, size, by, form = TYPES[c.type]
        if size < 0:
            raw = v if c.type == "bytea" else values.numeric_bytes(v) if c.type == "numeric" else values.jsonb_bytes(v) if c.type == "jsonb" else v.encode()
            if len(raw) <= SHORT:
                data += bytes([(len(raw) + 1) << 1 | 1]) + raw
            elif not long:
                return None
            else:
                data = data.ljust(align(len(data), 4), b"\0") + struct.pack("<I", (len(raw) + 4) << 2) + raw
        else:
            data = data.ljust(align(len(data), by), b"\0")
            if c.type == "uuid":
                data += bytes.fromhex(v.replace("-", ""))
            else:
                shift = values.EPOCH_DAYS if c.type == "date" else values.EPOCH_MICROS if c.type.startswith("timestamp") else 0
                data += struct.pack("<" + form, v - shift if shift else v)
    if all(present):
        return b"", data
    return bytes(sum(1 << b for b in range(8) if i + b < len(present) and present[i + b]) for i in range(0, len(present), 8)), data


def make_tuple(columns: list[Column], row: list, xmin: int, xmax: int = 0, ctid: tuple[int, int] = (0, 0), *, infomask: int | None = None, flags: int = 0) -> bytes:
    """A whole tuple: header, bitmap, padding, attributes."""
    bitmap, attrs = encode_attrs(columns, row)
    mask = (XMAX_INVALID if xmax == 0 else 0) if infomask is None else infomask
    mask |= (HAS_NULL if bitmap else 0) | (HAS_VARWIDTH if any(not c.dropped and TYPES[c.type][1] < 0 for c in columns) else 0)
    return raw_tuple(xmin, xmax, ctid, len(columns) | flags, mask, bitmap, attrs)


def raw_tuple(xmin: int, xmax: int, ctid: tuple[int, int], infomask2: int, infomask: int, bitmap: bytes, attrs: bytes) -> bytes:
    start = align(TUPLE_HEADER + len(bitmap), 8)
    head = struct.pack("<IIIHHHHHB", xmin, xmax, 0, ctid[0] >> 16, ctid[0] & 0xFFFF, ctid[1], infomask2, infomask, start)
    return (head + bitmap).ljust(start, b"\0") + attrs


def parse_tuple(raw: bytes, offset: int = 0) -> Tuple:
    if len(raw) < TUPLE_HEADER:
        raise FormatError("a tuple without header")
    xmin, xmax, _, hi, lo, off, mask2, mask, start = struct.unpack_from("<IIIHHHHHB", raw)
    size = (mask2 & NATTS) + 7 >> 3 if mask & HAS_NULL else 0
    if start < TUPLE_HEADER + size or start > len(raw):
        raise FormatError("a tuple's header is out of place")
    return Tuple(offset, xmin, xmax, (hi << 16 | lo, off), mask2, mask, raw[TUPLE_HEADER : TUPLE_HEADER + size], raw[start:], raw)


def pointers(page: bytes) -> list[tuple[int, int, int]]:
    """(kind, place, length) of each line pointer; of a redirect the place is the next item's number."""
    if len(page) != PAGE:
        raise FormatError(f"a page of {len(page)} bytes")
    lower = struct.unpack_from("<H", page, 12)[0]
    if lower == 0:
        return []
    if not PAGE_HEADER <= lower <= PAGE:
        raise FormatError("a page's pointers are out of place")
    words = struct.unpack_from(f"<{(lower - PAGE_HEADER) // POINTER}I", page, PAGE_HEADER)
    return [(w >> 15 & 3, w & 0x7FFF, w >> 17) for w in words]


def tuples(page: bytes) -> Iterator[Tuple]:
    """Every normal tuple of sane size, numbered from 1."""
    for i, (kind, at, size) in enumerate(pointers(page)):
        if kind == NORMAL and size >= TUPLE_HEADER and at + size <= PAGE:
            yield parse_tuple(page[at : at + size], i + 1)


def tuple_at(page: bytes, offset: int, items: list[tuple[int, int, int]] | None = None) -> Tuple | None:
    items = pointers(page) if items is None else items
    if not 1 <= offset <= len(items):
        return None
    kind, at, size = items[offset - 1]
    return parse_tuple(page[at : at + size], offset) if kind == NORMAL else None


def roots(page: bytes, items: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int]]:
    """(root, first tuple) of each chain: plain tuples and what redirects point to."""
    out = []
    for i, (kind, at, size) in enumerate(pointers(page) if items is None else items):
        if kind == REDIRECT:
            out.append((i + 1, at))
        elif kind == NORMAL:
            if size < TUPLE_HEADER or at + size > PAGE:
                raise FormatError("a tuple without header")
            if not (page[at + 18] | page[at + 19] << 8) & HEAP_ONLY:
                out.append((i + 1, i + 1))
    return out


def chain(page: bytes, first: int, limit: int = 1024, items: list[tuple[int, int, int]] | None = None) -> Iterator[Tuple]:
    """The versions of a chain, oldest first. It goes on while a tuple is marked as updated in place and
    the next one's xmin is its xmax; limit ends a cycle. items: pointers(page), for all chains of a page."""
    at, before = first, None
    items = pointers(page) if items is None else items
    for _ in range(limit):
        t = tuple_at(page, at, items)
        if t is None or before is not None and t.xmin != before:
            return
        yield t
        if not t.infomask2 & HOT_UPDATED or t.ctid[1] == at:
            return
        at, before = t.ctid[1], t.xmax


def build_page(slots: list[tuple], block: int, lsn: int, *, checksum: bool = True) -> bytes:
    """A page of slots: ("tuple", bytes), ("unused",), ("dead",) or ("redirect", item)."""
    items, upper, body = [], PAGE, {}
    for slot in slots:
        if slot[0] == "tuple":
            upper -= align(len(slot[1]), 8)
            body[upper] = slot[1]
            items.append(upper | NORMAL << 15 | len(slot[1]) << 17)
        else:
            items.append({"unused": 0, "dead": DEAD << 15}[slot[0]] if slot[0] != "redirect" else slot[1] | REDIRECT << 15)
    lower = PAGE_HEADER + POINTER * len(items)
    if lower > upper:
        raise FormatError("the tuples don't fit a page")
    page = bytearray(PAGE)
    struct.pack_into("<IIHHHHHHI", page, 0, lsn >> 32, lsn & 0xFFFFFFFF, 0, 0, lower, upper, PAGE, PAGE | 4, 0)
    struct.pack_into(f"<{len(items)}I", page, PAGE_HEADER, *items)
    for at, raw in body.items():
        page[at : at + len(raw)] = raw
    if checksum:
        struct.pack_into("<H", page, 8, int(bits.page_checksums([bytes(page)], [block])[0]))
    return bytes(page)


def page_lsn(page: bytes) -> int:
    hi, lo = struct.unpack_from("<II", page)
    return hi << 32 | lo


def toast_chunk(attrs: bytes) -> tuple[int, int, bytes]:
    """(value id, sequence, bytes) of a chunk's attributes."""
    value_id, seq = struct.unpack_from("<Ii", attrs)
    data, _ = read_varlena(attrs, 8)
    return value_id, seq, data


def make_pointer(raw_size: int, size: int, value_id: int, relation: int, method: int = 0) -> bytes:
    return struct.pack("<BBiIII", 1, 18, raw_size, size | method << 30, value_id, relation)
