"""Scalar functions that Spark expresses itself: positions, addresses, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 4294967295


def lsn_text(lsn: Column) -> Column:
    """A log position as HI/LO in hexadecimal."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(LOW)))


def parse_lsn(text: Column) -> Column:
    """The position of HI/LO; null for other text."""
    ok = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    half = lambda i: F.conv(F.split(text, "/")[i], 16, 10).cast("bigint")
    return F.when(ok, F.shiftleft(half(0), 32).bitwiseOR(half(1)))


def pack_ctid(block: Column, offset: Column) -> Column:
    return F.shiftleft(block.cast("bigint"), 16).bitwiseOR(offset.cast("bigint"))


def ctid_block(ctid: Column) -> Column:
    return F.shiftrightunsigned(ctid, 16)


def ctid_offset(ctid: Column) -> Column:
    return ctid.bitwiseAND(F.lit(65535).cast("bigint"))


def uuid_text(raw: Column) -> Column:
    """16 bytes in hyphenated lower-case hexadecimal."""
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def bytea_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))
