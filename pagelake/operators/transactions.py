"""From operations and transaction outcomes to a commit-ordered change log.

ops: xid, lsn, pos (place within equal lsn), and what the operation writes. outcomes: xid, lsn, committed,
subxids. A commit releases the operations of its own and its subtransactions' xids, all stamped with
its position; operations of aborted or unfinished transactions never appear, as only commits join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def members(outcomes: DataFrame) -> DataFrame:
    """A row for the top xid and each subxid of an outcome."""
    all_ = F.array_distinct(F.concat(F.array("xid"), F.coalesce("subxids", F.array().cast("array<bigint>"))))
    return outcomes.select(F.explode(all_).alias("xid"), F.col("xid").alias("top_xid"), F.col("lsn").alias("commit_lsn"), "committed")


def committed(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Operations of committed transactions, with top_xid and commit_lsn."""
    return ops.join(members(outcomes.where("committed")), "xid").drop("committed")


def aborted(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Operations that an abort, of their transaction or a subtransaction, throws away."""
    return ops.join(members(outcomes.where("not committed")).select("xid"), "xid", "left_semi")


def unfinished(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    return ops.join(members(outcomes).select("xid"), "xid", "left_anti")


def sequenced(ops: DataFrame, table: str | None = None) -> DataFrame:
    """_lsn and _seq: operations of a commit in log order, top and subtransactions interleaved.

    Numbers start at 0 in each commit (and table), so a window never spans more than one commit."""
    by = ["commit_lsn", *([table] if table else [])]
    seq = F.row_number().over(Window.partitionBy(*by).orderBy("lsn", "pos")) - 1
    return ops.withColumn("_lsn", F.col("commit_lsn")).withColumn("_seq", seq.cast("long"))


def emitted(ops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Log rows of sequenced operations: an update is its new version, a delete a tombstone of the old row.

    With keys, an update that changes its key (old_<key> columns, all null where the old row is unknown)
    also gives a tombstone of the old key just before it; a delete without its old row (all keys null)
    gives nothing. Without old_<key> columns keys are taken not to change."""
    rows = ops.withColumn("_deleted", F.col("op") == "delete")
    if not keys:
        return rows
    known, old_known, moved = F.lit(False), F.lit(False), F.lit(False)
    for k in keys:
        known = known | F.col(k).isNotNull()
        if f"old_{k}" in ops.columns:
            old_known = old_known | F.col(f"old_{k}").isNotNull()
            moved = moved | ~F.col(k).eqNullSafe(F.col(f"old_{k}"))
    if not all(f"old_{k}" in ops.columns for k in keys):
        return rows.where(~F.col("_deleted") | known)
    rows = rows.where(~F.col("_deleted") | known).withColumn("_seq", F.col("_seq") * 2 + 1)
    old = rows.where((F.col("op") == "update") & moved & old_known).withColumns({**{k: F.col(f"old_{k}") for k in keys}, "_deleted": F.lit(True), "_seq": F.col("_seq") - 1})
    return rows.unionByName(old)


def after_watermark(log: DataFrame, watermarks: DataFrame, table: str = "table") -> DataFrame:
    """Rows above their table's watermark; replayed ones go. watermarks: table, commit_lsn."""
    marks = watermarks.select(table, F.col("commit_lsn").alias("__mark"))
    return log.join(marks, table, "left").where(F.col("__mark").isNull() | (F.col("_lsn") > F.col("__mark"))).drop("__mark")


def restart_lsn(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """First position of the oldest unfinished transaction, or else the last commit."""
    first = unfinished(ops, outcomes).agg(F.min("lsn").alias("oldest_open"))
    last = outcomes.where("committed").agg(F.max("lsn").alias("last_commit"))
    return first.crossJoin(last).select("oldest_open", "last_commit", F.coalesce("oldest_open", "last_commit").alias("restart_lsn"))


def resume_lsn(restarts: DataFrame, slot: int | None, tip: int, page: int = 8192) -> DataFrame:
    """Where a stream starts: the least restart of all tables, else the slot's, else the tip, at a page's start."""
    least = F.coalesce(F.min("restart_lsn"), F.lit(slot).cast("long"), F.lit(tip).cast("long"))
    return restarts.agg(least.alias("lsn")).select(F.col("lsn").bitwiseAND(F.lit(~(page - 1)).cast("long")).alias("start_lsn"))


def parents(ops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """parent: the version that each update or delete starts from.

    ops: version, table, lsn, pos, op, ctid (what it creates), old_ctid (what it replaces). A version's
    parent is the newest earlier creator of its old address. Aborted operations must be gone before."""
    kind = ops.schema["version"].dataType
    makes = ops.where("op <> 'delete'").select("table", F.col("ctid").alias("at"), "lsn", "pos", F.col("version").alias("made"), F.lit(None).cast(kind).alias("asks"))
    looks = ops.where("old_ctid is not null").select("table", F.col("old_ctid").alias("at"), "lsn", "pos", F.lit(None).cast(kind).alias("made"), F.col("version").alias("asks"))
    before = Window.partitionBy("table", "at").orderBy("lsn", "pos", F.col("made").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = makes.unionByName(looks).withColumn("parent", F.last("made", ignorenulls=True).over(before)).where("asks is not null")
    return ops.join(found.select(F.col("asks").alias("version"), "parent"), "version", "left")


def chain_roots(versions: DataFrame, rounds: int = 40) -> DataFrame:
    """root and depth of each version: the parent pointers doubled until all point to roots.

    versions: version, parent (null for roots). rounds bounds a chain at 2 ** rounds versions."""
    from pagelake.session import staged

    first = F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")
    now = staged(versions.select("version", F.coalesce("parent", "version").alias("root"), first.alias("depth")), "chains")
    for _ in range(rounds):
        up = now.select(F.col("version").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        moved = F.coalesce(F.col("above") != F.col("root"), F.lit(False))
        next_ = now.join(up, "root", "left").select("version", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved.alias("moved"))
        next_ = staged(next_, "chains")
        now = next_.drop("moved")
        if not next_.where("moved").limit(1).count():
            return now
    raise ValueError("a chain of versions has a cycle")
