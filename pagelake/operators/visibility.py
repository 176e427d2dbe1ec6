"""Transaction status and tuple visibility as joins on decoded status pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two bits of a status byte, and the flags of a tuple header.
STATUS = {0: "in_progress", 1: "committed", 2: "aborted", 3: "sub_committed"}
XMIN_FROZEN, XMAX_INVALID, XMAX_LOCK_ONLY, XMAX_IS_MULTI = 0x0300, 0x0800, 0x0080, 0x1000
UPDATER = 3
XIDS_PER_PAGE = 32768


def statuses(pages: DataFrame) -> DataFrame:
    """(xid, status) from status pages (page_no, page): a byte holds four xids, lowest bits first."""
    byte = pages.select("page_no", F.posexplode(F.expr("transform(sequence(1, octet_length(page)), i -> conv(hex(substring(page, i, 1)), 16, 10))")).alias("at", "b"))
    each = byte.select((F.col("page_no") * XIDS_PER_PAGE + F.col("at") * 4).alias("first"), F.col("b").cast("int").alias("b"))
    two = each.select("first", "b", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("i"))
    return two.select((F.col("first") + F.col("i")).cast("long").alias("xid"), status_of(F.expr("shiftright(b, i * 2) & 3")).alias("status"))


def status_of(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in STATUS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def with_status(tuples: DataFrame, status: DataFrame, column: str, name: str) -> DataFrame:
    """The status of an xid column. Xids 1 and 2 are always committed; 0 has none; unknown ones run.

    The tuples are the left side of a left join, so where one xid has written most of them (a bulk load)
    adaptive execution splits its partition."""
    s = status.select(F.col("xid").alias("__xid"), F.col("status").alias("__status"))
    out = tuples.join(s, F.col(column) == F.col("__xid"), "left")
    known = F.when(F.col(column).isin(1, 2), "committed").when(F.col(column) == 0, F.lit(None)).otherwise(F.coalesce("__status", F.lit("in_progress")))
    return out.withColumn(name, known).drop("__xid", "__status")


def _flag(bits: int) -> Column:
    return F.col("infomask").bitwiseAND(bits)


def visible(tuples: DataFrame, status: DataFrame, updaters: DataFrame | None = None) -> DataFrame:
    """visible: the inserter committed (or is frozen) and no committed transaction deleted the tuple.

    tuples: xmin, xmax, infomask. An aborted or running deleter leaves it visible, as does one that only
    locks. updaters: (multi, updater) gives the deleter behind a group of lockers; without one in it the
    tuple stays visible. Hint bits are not looked at."""
    rows = tuples.withColumn("__deleter", F.when((_flag(XMAX_INVALID) != 0) | (F.col("xmax") == 0) | (_flag(XMAX_LOCK_ONLY) != 0), F.lit(0)).otherwise(F.col("xmax")).cast("long"))
    multi = (_flag(XMAX_IS_MULTI) != 0) & (F.col("__deleter") != 0)
    if updaters is not None:
        u = updaters.select(F.col("multi").alias("__multi"), F.col("updater").alias("__updater"))
        rows = rows.withColumn("__key", F.when(multi, F.col("__deleter"))).join(u, F.col("__key") == F.col("__multi"), "left")
        rows = rows.withColumn("__deleter", F.when(multi, F.coalesce("__updater", F.lit(0))).otherwise(F.col("__deleter"))).drop("__multi", "__updater", "__key")
    else:
        rows = rows.withColumn("__deleter", F.when(multi, F.raise_error("a group of lockers needs its updater")).otherwise(F.col("__deleter")).cast("long"))
    rows = with_status(with_status(rows, status, "xmin", "__in"), status, "__deleter", "__out")
    inserted = (_flag(XMIN_FROZEN) == XMIN_FROZEN) | (F.col("__in") == "committed")
    kept = (F.col("__deleter") == 0) | (F.col("__out") != "committed")
    return rows.withColumn("visible", F.coalesce(inserted, F.lit(False)) & kept).drop("__deleter", "__in", "__out")


def updaters(offsets: DataFrame, members: DataFrame, next_multi: int | None = None) -> DataFrame:
    """(multi, updater): the first member of each group that updates or deletes; null if all only lock.

    offsets: multi, offset of its first member; it ends where the next starts. members: offset, xid,
    status. The newest group has no end yet and is left out, or refused if it is asked for (next_multi)."""
    # groups are numbered densely: the next one's offset is an equality away, with no global sort
    ends = offsets.select((F.col("multi") - 1).alias("multi"), F.col("offset").alias("until"))
    groups = offsets.join(ends, "multi", "left")
    if next_multi is not None:
        groups = groups.where(F.col("multi") < next_multi).withColumn("until", F.when(F.col("until").isNull(), F.raise_error("the newest group has no end yet")).otherwise(F.col("until")).cast("long"))
    groups = groups.where("until is not null and until > offset")
    member = groups.select("multi", F.explode(F.sequence("offset", F.col("until") - 1)).alias("offset")).join(members, "offset")
    first = F.min(F.when(F.col("status") > UPDATER, F.struct("offset", "xid")))
    found = member.groupBy("multi").agg(first["xid"].alias("updater"))
    return groups.select("multi").join(found, "multi", "left")


def agreement(tuples: DataFrame, rule: Column) -> DataFrame:
    """How often another rule agrees with visible."""
    return tuples.groupBy((F.col("visible") == rule).alias("agrees")).agg(F.count("*").alias("n"))


def multixact_ends(offsets: DataFrame) -> DataFrame:
    """until by a window, for groups that are not numbered densely; it sorts all offsets."""
    return offsets.withColumn("until", F.lead("offset").over(Window.orderBy("multi")))
