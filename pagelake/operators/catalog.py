"""Table discovery, descriptors and reconciliation over catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import small


def tables(pg_class: DataFrame, pg_namespace: DataFrame, names: list[str] | None = None, schema: str = "public") -> DataFrame:
    """Ordinary tables of a schema: oid, relname, relfilenode, relnatts, reltoastrelid."""
    space = pg_namespace.where(F.col("nspname") == schema).select(F.col("oid").alias("relnamespace"))
    found = pg_class.where("relkind = 'r'").join(space, "relnamespace", "left_semi")
    return found.where(F.col("relname").isin(names)) if names is not None else found


def with_toast(found: DataFrame, pg_class: DataFrame) -> DataFrame:
    """toast_filenode of the table that holds long values, if any."""
    toast = pg_class.select(F.col("oid").alias("reltoastrelid"), F.col("relfilenode").alias("toast_filenode"))
    return found.join(toast, "reltoastrelid", "left")


def attributes(pg_attribute: DataFrame) -> DataFrame:
    """User columns in order: a row for each place. Repeated rows count once."""
    return pg_attribute.where("attnum >= 1").dropDuplicates(["attrelid", "attnum"])


def incomplete(found: DataFrame, pg_attribute: DataFrame) -> DataFrame:
    """Tables whose count of attributes isn't what they state."""
    n = attributes(pg_attribute).groupBy(F.col("attrelid").alias("oid")).agg(F.count("*").alias("n"))
    return found.join(n, "oid", "left").where(F.coalesce("n", F.lit(0)) != F.col("relnatts"))


def primary_keys(pg_index: DataFrame, pg_attribute: DataFrame) -> DataFrame:
    """(oid, position, attname) of primary key columns; included columns are no part of the key."""
    key = pg_index.where("indisprimary").select(F.col("indrelid").alias("attrelid"), "indnkeyatts", F.posexplode("indkey").alias("position", "attnum"))
    key = key.where("position < indnkeyatts")
    return key.join(attributes(pg_attribute), ["attrelid", "attnum"]).select(F.col("attrelid").alias("oid"), "position", "attname")


def descriptors(found: DataFrame, pg_class: DataFrame, pg_attribute: DataFrame, pg_index: DataFrame) -> DataFrame:
    """A row for each table: its files, columns in order (dropped ones keep their place), key columns, and
    whether a column has a value that old tuples lack. A table whose attributes are incomplete is left out.

    Columns of a table are few (1,600 at most), so they are collected to one array."""
    column = F.struct("attnum", "attname", "atttypid", "attlen", "attalign", "attisdropped")
    columns = attributes(pg_attribute).groupBy(F.col("attrelid").alias("oid")).agg(
        F.sort_array(F.collect_list(column)).alias("columns"), F.max(F.col("atthasmissing") & ~F.col("attisdropped")).alias("has_fast_defaults"), F.count("*").alias("n")
    )
    keys = primary_keys(pg_index, pg_attribute).groupBy("oid").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "attname"))), lambda k: k["attname"]).alias("pk"))
    whole = with_toast(found, pg_class).join(columns, "oid").where(F.col("n") == F.col("relnatts")).join(keys, "oid", "left")
    return whole.select("oid", "relname", "relfilenode", "toast_filenode", "columns", F.coalesce("pk", F.array().cast("array<string>")).alias("pk"), "has_fast_defaults")


def heap_columns(described: list) -> list:
    """Columns for the codecs of a descriptor's array; an unknown type is refused with the known ones."""
    from pagelake.codec import heap

    out = []
    for c in described:
        if c["attisdropped"]:
            out.append(heap.Column(c["attname"], "", True, c["attlen"], {"c": 1, "s": 2, "i": 4, "d": 8}[c["attalign"]]))
        elif c["atttypid"] not in heap.BY_OID:
            raise TypeError(f"column {c['attname']} has type {c['atttypid']}; known: {', '.join(sorted(heap.TYPES))}")
        else:
            out.append(heap.Column(c["attname"], heap.BY_OID[c["atttypid"]]))
    return out


def attachable(found: DataFrame, tracked: DataFrame, failed: DataFrame) -> DataFrame:
    """Tables neither tracked (by oid) nor failed before (by name)."""
    return found.join(tracked.select("oid"), "oid", "left_anti").join(failed.select("relname"), "relname", "left_anti")


def reconciled(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """What became of each table, by oid: vanished, new, rewritten, columns, renamed or same.

    A name that another oid uses now doesn't rebind a table, and a renamed table is followed."""
    o = old.select("oid", F.col("relname").alias("old_name"), F.col("relfilenode").alias("old_node"), F.col("columns").alias("old_columns"))
    f = fresh.select("oid", F.col("relname").alias("new_name"), F.col("relfilenode").alias("new_node"), F.col("columns").alias("new_columns"))
    change = (
        F.when(F.col("new_name").isNull(), "vanished").when(F.col("old_name").isNull(), "new").when(F.col("old_node") != F.col("new_node"), "rewritten")
        .when(F.col("old_columns") != F.col("new_columns"), "columns").when(F.col("old_name") != F.col("new_name"), "renamed").otherwise("same")
    )
    return o.join(f, "oid", "full_outer").select("oid", "old_name", "new_name", change.alias("change"))


def routed(records: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Records of tracked relations with their table; all others go before any tuple is decoded."""
    return records.join(small(descriptors), "relfilenode")


def gaps(states: DataFrame, first_lsn: int) -> DataFrame:
    """Tables whose watermark lies before the first position that a stream still has."""
    return states.where((F.col("watermark") > 0) & (F.col("watermark") < first_lsn))


def lost_files(listing: DataFrame, active: DataFrame, before_ms: int) -> DataFrame:
    """Files that no version refers to and that are old enough to delete."""
    return listing.where(F.col("modified_ms") < before_ms).join(active.select("path"), "path", "left_anti")
