"""Versioned change logs: current state, as-of reads, merges, conforming, compaction, statistics.

A log has a row for each version of a row, with `_lsn` (commit position), `_seq` (place in the commit),
`_deleted` (a tombstone) and `_ctid` (packed physical address). The newest version of a key is ranked
first and only then are tombstones dropped: the other way round a deleted row would come back.
Ranking is `row_number() = 1`, which Spark plans as a partial and a final group limit, so a key's
older versions mostly never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

LSN, SEQ, DELETED, CTID = "_lsn", "_seq", "_deleted", "_ctid"
META = (LSN, SEQ, DELETED, CTID)


def newest(log: DataFrame, keys: Sequence[str], order: Sequence[str] = (LSN, SEQ)) -> DataFrame:
    """The newest version of every key, tombstones included. Null keys are one key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def newest_maxby(log: DataFrame, keys: Sequence[str], order: Sequence[str] = (LSN, SEQ)) -> DataFrame:
    """The same by aggregation: one pass with partial maxima and no sort of versions."""
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return log.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*log.columns)


def current_state(log: DataFrame, keys: Sequence[str], *, meta: bool = False) -> DataFrame:
    """Live rows as of the end of the log."""
    live = newest(log, keys).where(~F.col(DELETED))
    return live if meta else live.drop(*META)


def as_of(log: DataFrame, keys: Sequence[str], lsn: int | Column, *, meta: bool = False) -> DataFrame:
    """Live rows as of a position; the filter reaches the scan."""
    return current_state(log.where(F.col(LSN) <= lsn), keys, meta=meta)


def point_read(log: DataFrame, key: dict[str, object], lsn: int | None = None) -> DataFrame:
    """One key's state: the equality reaches the scan, where file statistics prune by it."""
    for name, value in key.items():
        log = log.where(F.col(name).eqNullSafe(F.lit(value)))
    return current_state(log, list(key)) if lsn is None else as_of(log, list(key), lsn)


def merge_tail(lake: DataFrame, tail: DataFrame | None) -> DataFrame:
    """Lake and tail by column name; versions in both count once. Columns of one alone are null in the other."""
    if tail is None:
        return lake
    return lake.unionByName(tail, allowMissingColumns=True)


def fresh_state(lake: DataFrame, tail: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Current state over lake and tail."""
    return current_state(merge_tail(lake, tail), keys)


def stats(log: DataFrame) -> DataFrame:
    """Rows, tombstones and newest position."""
    return log.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col(DELETED).cast("long")), F.lit(0)).alias("n_deleted"), F.max(LSN).alias("max_lsn"))


def version_counts(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("n_versions"), F.sum(F.col(DELETED).cast("long")).alias("n_deleted"))


def compact(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest live version of each key with all columns, sorted in each file by key so that files prune.

    A log without key columns, or whose schema lacks one, is kept as it is."""
    if not keys or any(k not in log.columns for k in keys):
        return log
    return current_state(log, keys, meta=True).sortWithinPartitions(*keys)


def mirror(log: DataFrame) -> DataFrame:
    """Newest live version at each physical address. An update that moves a row is a tombstone of its
    old address where the log has `_old_ctid`."""
    if "_old_ctid" in log.columns:
        left = log.where("_old_ctid is not null and _old_ctid <> _ctid").withColumns({CTID: F.col("_old_ctid"), DELETED: F.lit(True)})
        # the old address is left just before the new one is written
        log = log.withColumn("__half", F.lit(1)).unionByName(left.withColumn("__half", F.lit(0)))
        live = newest(log, [CTID], (LSN, SEQ, "__half")).drop("__half", "_old_ctid")
    else:
        live = newest(log, [CTID])
    return live.where(~F.col(DELETED))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema by name; missing ones null, further ones dropped, a changed type refused."""
    columns = []
    for f in schema:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif not same_type(df.schema[f.name].dataType, f.dataType):
            raise TypeError(f"column {f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


def same_type(a: DataType, b: DataType) -> bool:
    return a.simpleString() == b.simpleString()


def evolve(table: StructType, live: Iterable[StructField]) -> StructType:
    """The table's columns, then the new ones. Dropped ones stay; a changed type is refused."""
    have = {f.name: f for f in table}
    fields = list(table)
    for f in live:
        if f.name not in have:
            fields.append(StructField(f.name, f.dataType, True))
        elif not same_type(have[f.name].dataType, f.dataType):
            raise TypeError(f"column {f.name} changes from {have[f.name].dataType.simpleString()} to {f.dataType.simpleString()}")
    return StructType(fields)


def reshape(rows: DataFrame, old: Sequence[str], new: Sequence[str], types: dict[str, DataType]) -> DataFrame:
    """Rows of an old column order in a new one; columns without a value are null."""
    return rows.select(*(F.col(c) if c in old else F.lit(None).cast(types.get(c, StringType())).alias(c) for c in new))


def newest_schema(batches: DataFrame, schema_id: str = "schema_id") -> DataFrame:
    """Batches of the newest schema alone."""
    top = batches.agg(F.max(schema_id).alias("__top"))
    return batches.join(F.broadcast(top), F.col(schema_id) == F.col("__top")).drop("__top")


def numbered(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 in order, without one task that sorts them all: ranges are sorted apart, and
    each begins where the ones before it end."""
    from pagelake.session import staged

    places = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "numbered")
    range_, place = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = places.groupBy(range_.alias("__range")).agg(F.count("*").alias("__n"))  # a row a range
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    met = places.withColumn("__range", range_).join(F.broadcast(before.select("__range", "__before")), "__range")
    return met.withColumn(name, place + F.coalesce("__before", F.lit(0)) + 1).drop("__range", "__before")


def tombstones(log: DataFrame, keys: Sequence[str], lsn: int | Column) -> DataFrame:
    """A tombstone at a position for all live rows, numbered by key: what a rewrite of the table writes first."""
    live = numbered(current_state(log, keys, meta=True), keys, SEQ)
    return live.withColumns({LSN: (F.lit(lsn) if isinstance(lsn, int) else lsn).cast("long"), DELETED: F.lit(True)}).select(*log.columns)
