"""Queries of the lake, transaction, time-travel, visibility and catalog operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import columns as X
from pagelake.operators import catalog, changelog, timetravel, transactions, visibility
from pagelake.plans.registry import register
from pagelake.session import table


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def cl_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as versions of their customer's row."""
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderpriority", micros("o_orderdate").alias("_lsn"), F.col("o_orderkey").alias("_seq"), (F.col("o_orderstatus") == "F").alias("_deleted"),
        X.pack_ctid(F.col("o_orderkey") % 97, F.col("o_orderkey") % 13 + 1).alias("_ctid"),
    )


SQL_ORDERS = """select o_custkey, o_orderpriority, epoch_us(o_orderdate) as _lsn, o_orderkey as _seq, o_orderstatus = 'F' as _deleted,
    ((o_orderkey % 97) << 16) | (o_orderkey % 13 + 1) as _ctid from orders"""


def cl_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated order lines as versions."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", micros("l_shipdate").alias("_lsn"), (F.col("l_returnflag") == "R").alias("_deleted"))


def ops(spark: SparkSession, sf: str) -> DataFrame:
    """Events as operations: seven a transaction, those divisible by three in a subtransaction."""
    top = F.expr("event_id div 7")
    return table(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, top + 1_000_000_000).otherwise(top).alias("xid"), F.col("event_id").alias("lsn"), F.lit(0).alias("pos"), "user_id", "event_type",
        F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), F.lit("events").alias("table"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A commit or (each fifth transaction) an abort at its last event; the last one is unfinished."""
    top = F.expr("event_id div 7").alias("xid")
    done = table(spark, sf, "events").groupBy(top).agg(F.max("event_id").alias("lsn"), F.count("*").alias("n")).where("n = 7")
    return done.select("xid", "lsn", (F.col("xid") % 5 != 0).alias("committed"), F.array(F.col("xid") + 1_000_000_000).alias("subxids"))


SQL_OPS = """ops as (select case when event_id % 3 = 0 then event_id // 7 + 1000000000 else event_id // 7 end as xid, event_id as lsn, user_id, event_type from events),
done as (select event_id // 7 as xid, max(event_id) as lsn, (event_id // 7) % 5 <> 0 as committed from events group by 1, 3 having count(*) = 7),
members as (select unnest([xid, xid + 1000000000]) as xid, xid as top_xid, lsn as commit_lsn, committed from done)"""


# --- current state and its kin -------------------------------------------------------------------

_STATE = f"""select o_custkey, o_orderpriority from (select * from ({SQL_ORDERS}) qualify row_number() over (partition by o_custkey order by _lsn desc, _seq desc) = 1) where not _deleted"""


@register("current_state", _STATE)
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.current_state(cl_orders(spark, sf), ["o_custkey"])


@register("current_state_maxby", _STATE)
def current_state_maxby(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.newest_maxby(cl_orders(spark, sf), ["o_custkey"]).where("not _deleted").drop(*changelog.META)


@register(
    "current_state_lineitem",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, l_returnflag = 'R' as d from lineitem qualify row_number() over (
    partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc) = 1) where not d""",
)
def current_state_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    log = cl_lineitem(spark, sf)
    return changelog.newest(log, ["l_orderkey", "l_linenumber"], ["_lsn", "l_partkey", "l_suppkey"]).where("not _deleted").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_MIDDLE = 820_000_000_000_000
_AS_OF = """select o_custkey, o_orderpriority from (select * from ({log}) where _lsn <= (select cast(median(epoch_us(o_orderdate)) as bigint) // 86400000000 * 86400000000 from orders)
    qualify row_number() over (partition by o_custkey order by _lsn desc, _seq desc) = 1) where not _deleted"""


def middle(spark: SparkSession, sf: str) -> int:
    """The day of the median order."""
    return int(table(spark, sf, "orders").agg(F.median(micros("o_orderdate"))).first()[0]) // 86_400_000_000 * 86_400_000_000


@register("as_of_lsn", _AS_OF.format(log=SQL_ORDERS))
def as_of_lsn(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.as_of(cl_orders(spark, sf), ["o_custkey"], middle(spark, sf))


@register("point_read", f"select * from ({_STATE}) where o_custkey = 7")
def point_read(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.point_read(cl_orders(spark, sf), {"o_custkey": 7})


@register("changelog_stats", f"select count(*) as n_rows, cast(sum(_deleted::int) as bigint) as n_deleted, max(_lsn) as max_lsn from ({SQL_ORDERS})")
def changelog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.stats(cl_orders(spark, sf))


@register("tombstones_latest", f"select o_custkey, _lsn, _seq from (select * from ({SQL_ORDERS}) qualify row_number() over (partition by o_custkey order by _lsn desc, _seq desc) = 1) where _deleted")
def tombstones_latest(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.newest(cl_orders(spark, sf), ["o_custkey"]).where("_deleted").select("o_custkey", "_lsn", "_seq")


@register("version_counts", f"select o_custkey, count(*) as n_versions, cast(sum(_deleted::int) as bigint) as n_deleted from ({SQL_ORDERS}) group by 1")
def version_counts(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.version_counts(cl_orders(spark, sf), ["o_custkey"])


@register("fresh_merge", _STATE)
def fresh_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Lake up to the middle, tail from a day before it: what is in both counts once."""
    log, at = cl_orders(spark, sf), middle(spark, sf)
    return changelog.fresh_state(log.where(F.col("_lsn") <= at), log.where(F.col("_lsn") > at - 86_400_000_000), ["o_custkey"])


@register(
    "schema_evolved_union",
    f"""select o_custkey, o_orderpriority, note from (select * from (select *, case when _lsn > (select cast(median(epoch_us(o_orderdate)) as bigint) // 86400000000 * 86400000000 from orders) then 'n' || _seq end as note
    from ({SQL_ORDERS})) qualify row_number() over (partition by o_custkey order by _lsn desc, _seq desc) = 1) where not _deleted""",
)
def schema_evolved_union(spark: SparkSession, sf: str) -> DataFrame:
    """The tail has a column that the lake has not."""
    log, at = cl_orders(spark, sf), middle(spark, sf)
    tail = log.where(F.col("_lsn") > at).withColumn("note", F.concat(F.lit("n"), F.col("_seq").cast("string")))
    return changelog.fresh_state(log.where(F.col("_lsn") <= at), tail, ["o_custkey"])


@register("conform_columns", "select o_custkey, o_orderpriority, cast(null as varchar) as later from orders")
def conform_columns(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return changelog.conform(cl_orders(spark, sf), StructType.fromDDL("o_custkey bigint, o_orderpriority string, later string"))


@register("newest_schema_batches", "select o_orderkey, o_orderkey % 3 as schema_id from orders where o_orderkey % 3 = (select max(o_orderkey % 3) from orders)")
def newest_schema_batches(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.newest_schema(table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("schema_id")))


@register("compaction_before_after", f"select (select count(*) from ({SQL_ORDERS})) as n_before, (select count(*) from ({_STATE})) as n_after")
def compaction_before_after(spark: SparkSession, sf: str) -> DataFrame:
    log = cl_orders(spark, sf)
    before, after = log.agg(F.count("*").alias("n_before")), changelog.compact(log, ["o_custkey"]).agg(F.count("*").alias("n_after"))
    return before.crossJoin(after)  # one row each


@register("mirror_by_ctid", f"select _ctid, o_custkey, _seq from (select * from ({SQL_ORDERS}) qualify row_number() over (partition by _ctid order by _lsn desc, _seq desc) = 1) where not _deleted")
def mirror_by_ctid(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.mirror(cl_orders(spark, sf)).select("_ctid", "o_custkey", "_seq")


@register("remap_tombstones", f"select o_custkey, 9000000000000000 as _lsn, row_number() over (order by o_custkey) as _seq, true as _deleted from ({_STATE})")
def remap_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    log = cl_orders(spark, sf)
    live = changelog.current_state(log, ["o_custkey"], meta=True).withColumn("_lsn", F.lit(1).cast("long"))
    return changelog.tombstones(live, ["o_custkey"], 9_000_000_000_000_000).select("o_custkey", "_lsn", "_seq", "_deleted")


# --- transactions --------------------------------------------------------------------------------


@register("committed_ops", f"with {SQL_OPS} select o.xid, o.lsn, m.top_xid, m.commit_lsn from ops o join members m using (xid) where m.committed")
def committed_ops(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.committed(ops(spark, sf), outcomes(spark, sf)).select("xid", "lsn", "top_xid", "commit_lsn")


@register("aborted_ops_dropped", f"with {SQL_OPS} select o.xid, o.lsn from ops o semi join (select xid from members where not committed) m using (xid)")
def aborted_ops_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.aborted(ops(spark, sf), outcomes(spark, sf)).select("xid", "lsn")


@register("unfinished_ops", f"with {SQL_OPS} select o.xid, o.lsn from ops o anti join members m using (xid)")
def unfinished_ops(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.unfinished(ops(spark, sf), outcomes(spark, sf)).select("xid", "lsn")


@register("subxact_commit", f"with {SQL_OPS} select m.top_xid, count(*) as n_ops, count(*) filter (where o.xid <> m.top_xid) as n_sub from ops o join members m using (xid) where m.committed group by 1")
def subxact_commit(spark: SparkSession, sf: str) -> DataFrame:
    done = transactions.committed(ops(spark, sf), outcomes(spark, sf))
    return done.groupBy("top_xid").agg(F.count("*").alias("n_ops"), F.count_if(F.col("xid") != F.col("top_xid")).alias("n_sub"))


_LOG = f"""{SQL_OPS}, log as (select user_id, event_type, o.lsn as op_lsn, m.commit_lsn as _lsn, row_number() over (partition by m.commit_lsn order by o.lsn) - 1 as _seq, event_type = 'error' as _deleted
from ops o join members m using (xid) where m.committed)"""


def cl_events(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.emitted(transactions.sequenced(transactions.committed(ops(spark, sf), outcomes(spark, sf)), "table"))


@register("commit_order_seq", f"with {_LOG} select op_lsn, _lsn, _seq from log")
def commit_order_seq(spark: SparkSession, sf: str) -> DataFrame:
    return cl_events(spark, sf).select(F.col("lsn").alias("op_lsn"), "_lsn", "_seq")


@register("current_state_events", f"with {_LOG} select user_id, event_type, op_lsn from (select * from log qualify row_number() over (partition by user_id order by _lsn desc, _seq desc) = 1) where not _deleted")
def current_state_events(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.current_state(cl_events(spark, sf), ["user_id"]).select("user_id", "event_type", F.col("lsn").alias("op_lsn"))


@register("dedupe_replay", f"with {_LOG} select op_lsn, _lsn from log where _lsn > 500")
def dedupe_replay(spark: SparkSession, sf: str) -> DataFrame:
    marks = spark.sql("select 'events' as table, 500L as commit_lsn")
    return transactions.after_watermark(cl_events(spark, sf), marks).select(F.col("lsn").alias("op_lsn"), "_lsn")


@register(
    "restart_lsn",
    f"""with {SQL_OPS}, a as (select min(o.lsn) as oldest_open from ops o anti join members using (xid)), b as (select max(lsn) as last_commit from done where committed)
    select oldest_open, last_commit, coalesce(oldest_open, last_commit) as restart_lsn from a, b""",
)
def restart_lsn(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.restart_lsn(ops(spark, sf), outcomes(spark, sf))


@register("resume_min", "select (min(o_orderkey * 100000 + 54321) // 8192) * 8192 as start_lsn from orders")
def resume_min(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.resume_lsn(table(spark, sf, "orders").select((F.col("o_orderkey") * 100_000 + 54_321).alias("restart_lsn")), None, 0)


@register(
    "preimage_parents",
    """select event_id as version, last_value(event_id ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as parent from events""",
)
def preimage_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Each event updates its user's row in place."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("version"), F.lit("t").alias("table"), F.col("event_id").alias("lsn"), F.lit(0).alias("pos"), F.lit("update").alias("op"), F.col("user_id").alias("ctid"), F.col("user_id").alias("old_ctid"))
    return transactions.parents(e).select("version", "parent")


@register("preimage_chains", "select event_id as version, min(event_id) over (partition by user_id) as root, row_number() over (partition by user_id order by event_id) - 1 as depth from events")
def preimage_chains(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.chain_roots(preimage_parents(spark, sf))


# --- time travel ---------------------------------------------------------------------------------


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as fragments: relation by line number, ten blocks and more from the part, at the order's position."""
    start = F.col("l_partkey") % 500
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("rel"), start.alias("start"), (start + 10 + F.col("l_suppkey") % 5).alias("end"), (F.col("l_orderkey") * 10).alias("lsn"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("request"), (F.col("user_id") % 8).alias("rel"), (F.col("event_id") % 520).alias("block"), (F.col("event_id") * 7 % 15_000 * 10).alias("read_lsn"))


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ranges of up to five blocks."""
    start = F.col("o_custkey") % 500
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("range"), (F.col("o_orderkey") % 8).alias("rel"), start.alias("start"), (start + F.col("o_orderkey") % 6).alias("end"))


def _sql_resolve(requests: str, fragments: str, floor: int) -> str:
    return f"""(select request, rel, block, read_lsn, case when outcome = 'serve' then b end as base, outcome, n > 0 as covered, b as any_base from (select *, case when b = read_lsn or b >= {floor} then 'serve' when n > 0 then 'below_horizon' else 'uncovered' end as outcome
    from (select r.request, r.rel, r.block, r.read_lsn, max(case when f.lsn <= r.read_lsn then f.lsn end) as b, count(f.lsn) as n from {requests} r left join {fragments} f on r.rel = f.rel and r.block >= f.s and r.block < f.e group by all)))"""


SQL_TRAVEL = """fragments as (select l_linenumber::bigint as rel, l_partkey % 500 as s, l_partkey % 500 + 10 + l_suppkey % 5 as e, l_orderkey * 10 as lsn from lineitem),
requests as (select event_id as request, user_id % 8 as rel, event_id % 520 as block, event_id * 7 % 15000 * 10 as read_lsn from events)"""


@register("timetravel_resolve", f"with {SQL_TRAVEL} select request, rel, block, read_lsn, base, outcome from {_sql_resolve('requests', 'fragments', 50_000)}")
def timetravel_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return timetravel.resolve(requests(spark, sf), fragments(spark, sf), 50_000, bucket=64)


@register(
    "branch_resolve",
    f"""with {SQL_TRAVEL}, own as (select * from fragments where lsn > 60000 and s % 3 = 0), parent as (select * from fragments where lsn <= 90000),
    frozen as (select request, rel, block, least(read_lsn, 60000) as read_lsn from requests),
    mine as {_sql_resolve('requests', 'own', 60_000)}, theirs as {_sql_resolve('frozen', 'parent', 20_000)}
    select m.request, m.rel, m.block, m.read_lsn, case when m.covered then 'own' else 'parent' end as "from", case when m.covered then m.base else t.base end as base,
    case when m.covered then m.outcome else t.outcome end as outcome from mine m join theirs t using (request)""",
)
def branch_resolve(spark: SparkSession, sf: str) -> DataFrame:
    f = fragments(spark, sf)
    return timetravel.branch_resolve(requests(spark, sf), f.where("lsn <= 90000"), 20_000, f.where("lsn > 60000 and start % 3 = 0"), 60_000, 60_000, bucket=64)


@register(
    "gc_redundant",
    f"""with {SQL_TRAVEL}, ranges as (select o_orderkey as range, o_orderkey % 8 as rel, o_custkey % 500 as s, o_custkey % 500 + o_orderkey % 6 as e from orders),
    blocks as (select range, rel, unnest(generate_series(s, e - 1)) as block from ranges where e > s),
    good as (select distinct rel, unnest(generate_series(s, e - 1)) as block from fragments where lsn between 50000 and 140000),
    bad as (select distinct range from blocks anti join good using (rel, block))
    select range, rel, s as start, e as "end", range not in (select range from bad) as redundant from ranges""",
)
def gc_redundant(spark: SparkSession, sf: str) -> DataFrame:
    return timetravel.image_redundant(ranges(spark, sf), fragments(spark, sf), 50_000, 140_000, bucket=64)


@register("gc_horizon", "select least(500, min(c_custkey * 3 + 200)) as horizon from customer")
def gc_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return timetravel.gc_horizon(table(spark, sf, "customer").select((F.col("c_custkey") * 3 + 200).alias("branch_lsn")), 500)


# --- visibility ----------------------------------------------------------------------------------


def status_pages(spark: SparkSession, sf: str, first: int = 0) -> DataFrame:
    """Status pages that are made from transactions, numbered from first on: one byte for four xids."""
    done = table(spark, sf, "events").select((F.col("event_id") + first).alias("xid"), (F.col("event_id") * 31 % 7 % 4).alias("code"))
    four = done.groupBy(F.expr("xid div 4").alias("at")).agg(F.sum(F.expr("shiftleft(code, cast(xid % 4 as int) * 2)")).alias("b"))
    pages = four.groupBy(F.expr("at div 8192").alias("page_no")).agg(F.sort_array(F.collect_list(F.struct("at", "b"))).alias("l"))
    return pages.select("page_no", F.unhex(F.array_join(F.expr("transform(l, x -> lpad(hex(x.b), 2, '0'))"), "")).alias("page"))


SQL_CODE = "case event_id * 31 % 7 % 4 when 0 then 'in_progress' when 1 then 'committed' when 2 then 'aborted' else 'sub_committed' end"


@register("clog_status", f"select event_id as xid, {SQL_CODE} as status from events")
def clog_status(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.statuses(status_pages(spark, sf))


def tuples(spark: SparkSession, sf: str) -> DataFrame:
    flags = F.when(F.col("o_orderkey") % 11 == 0, 0x0300).otherwise(0) + F.when(F.col("o_orderkey") % 13 == 0, 0x0800).otherwise(0) + F.when(F.col("o_orderkey") % 17 == 0, 0x0080).otherwise(0) + F.when(F.col("o_orderkey") % 19 == 0, 0x1000).otherwise(0)
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 20_000).alias("xmin"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.when(F.col("o_orderkey") % 19 == 0, F.col("o_orderkey") % 300).otherwise(F.col("o_orderkey") * 7 % 20_000)).cast("long").alias("xmax"), flags.cast("int").alias("infomask"))


def multis(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A group for each event, of two to four members."""
    e = table(spark, sf, "events").select("event_id")
    offsets = e.select(F.col("event_id").alias("multi"), (F.col("event_id") * 3 + F.col("event_id") % 2).alias("offset"))
    members = e.select(F.explode(F.sequence(F.col("event_id") * 3, F.col("event_id") * 3 + 2)).alias("offset"))
    return offsets, members.select("offset", (F.col("offset") * 17 % 9000).alias("xid"), (F.col("offset") * 5 % 6).cast("int").alias("status"))


SQL_MULTI = """groups as (select event_id as multi, event_id * 3 + event_id % 2 as o, lead(event_id * 3 + event_id % 2) over (order by event_id) as until from events),
members as (select o, o * 17 % 9000 as xid, o * 5 % 6 as status from (select event_id * 3 + unnest(range(3)) as o from events)),
spread as (select multi, unnest(range(o, until)) as o from groups where until > o),
updaters as (select s.multi, arg_min(m.xid, m.o) filter (where m.status > 3) as updater from spread s left join members m using (o) group by 1)"""


@register("multixact_updater", f"with {SQL_MULTI} select multi, updater from updaters")
def multixact_updater(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.updaters(*multis(spark, sf))


_TUPLES = """tuples as (select o_orderkey, o_orderkey % 20000 as xmin, case when o_orderkey % 3 = 0 then 0 when o_orderkey % 19 = 0 then o_orderkey % 300 else o_orderkey * 7 % 20000 end as xmax,
o_orderkey % 11 = 0 as frozen, o_orderkey % 13 = 0 or o_orderkey % 17 = 0 as kept, o_orderkey % 19 = 0 as multi from orders)"""
_VISIBLE = f"""with status as (select event_id as xid, {SQL_CODE} as status from events), {SQL_MULTI}, {_TUPLES},
deleted as (select t.*, case when kept or xmax = 0 then 0 when t.multi then coalesce(u.updater, 0) else xmax end as deleter from tuples t left join updaters u on u.multi = t.xmax),
judged as (select d.o_orderkey, d.frozen or d.xmin in (1, 2) or coalesce(a.status = 'committed', false) and d.xmin <> 0 as inserted,
  d.deleter = 0 or not (d.deleter in (1, 2) or coalesce(b.status = 'committed', false)) as alive, d.xmax from deleted d left join status a on a.xid = d.xmin left join status b on b.xid = d.deleter),
visible as (select o_orderkey, inserted and alive as visible, xmax from judged)"""


def visible_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.visible(tuples(spark, sf), visibility.statuses(status_pages(spark, sf)), visibility.updaters(*multis(spark, sf)))


@register("visible_rows", f"{_VISIBLE} select o_orderkey, visible from visible")
def visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    return visible_tuples(spark, sf).select("o_orderkey", "visible")


@register("visibility_agreement", f"{_VISIBLE} select visible = (xmax = 0) as agrees, count(*) as n from visible group by 1")
def visibility_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.agreement(visible_tuples(spark, sf), F.col("xmax") == 0)


# --- catalog -------------------------------------------------------------------------------------


def catalogs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Suppliers as tables, parts as their columns."""
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    pg_class = s.select((key + 16384).alias("oid"), F.col("s_name").alias("relname"), F.when(key % 4 == 0, 11).otherwise(2200).cast("long").alias("relnamespace"), (key + 20000 + key % 2).alias("relfilenode"), F.when(key % 5 == 0, "i").otherwise("r").alias("relkind"), F.when(key % 3 == 0, 4).otherwise(3).alias("relnatts"), F.when(key % 6 == 1, key + 16385).otherwise(0).cast("long").alias("reltoastrelid"))
    pg_attribute = s.select((key + 16384).alias("attrelid"), F.explode(F.array(*(F.lit(i) for i in (-1, 1, 2, 3)))).alias("attnum")).withColumn("attname", F.concat(F.lit("c"), F.col("attnum").cast("string")))
    pg_index = s.select((key + 16384).alias("indrelid"), (key % 7 != 0).alias("indisprimary"), (1 + key % 2).cast("int").alias("indnkeyatts"), F.array(F.lit(3), F.lit(1)).alias("indkey"))
    pg_namespace = spark.sql("select * from values (11L, 'pg_catalog'), (2200L, 'public') as t(oid, nspname)")
    return {"pg_class": pg_class, "pg_attribute": pg_attribute, "pg_index": pg_index, "pg_namespace": pg_namespace}


SQL_CLASS = """pg_class as (select s_suppkey + 16384 as oid, s_name as relname, case when s_suppkey % 4 = 0 then 11 else 2200 end as relnamespace, s_suppkey + 20000 + s_suppkey % 2 as relfilenode,
case when s_suppkey % 5 = 0 then 'i' else 'r' end as relkind, case when s_suppkey % 3 = 0 then 4 else 3 end as relnatts, case when s_suppkey % 6 = 1 then s_suppkey + 16385 else 0 end as toast, s_suppkey from supplier)"""


@register("catalog_tables", f"with {SQL_CLASS} select a.oid, a.relname, b.relfilenode as toast_filenode from pg_class a left join pg_class b on a.toast = b.oid where a.relkind = 'r' and a.relnamespace = 2200")
def catalog_tables(spark: SparkSession, sf: str) -> DataFrame:
    c = catalogs(spark, sf)
    return catalog.with_toast(catalog.tables(c["pg_class"], c["pg_namespace"]), c["pg_class"]).select("oid", "relname", "toast_filenode")


@register("catalog_pk", "select s_suppkey + 16384 as oid, p as position, ['c3', 'c1'][p + 1] as attname from supplier, (select unnest([0, 1]) as p) where s_suppkey % 7 <> 0 and p < 1 + s_suppkey % 2")
def catalog_pk(spark: SparkSession, sf: str) -> DataFrame:
    c = catalogs(spark, sf)
    return catalog.primary_keys(c["pg_index"], c["pg_attribute"])


@register(
    "catalog_descriptors",
    f"""with {SQL_CLASS} select a.oid, a.relname, a.relfilenode, b.relfilenode as toast_filenode, 'c1:23,c2:25,c3:23' as columns,
    case when a.s_suppkey % 7 = 0 then '' when a.s_suppkey % 2 = 1 then 'c3,c1' else 'c3' end as pk, a.s_suppkey % 2 = 1 as has_fast_defaults
    from pg_class a left join pg_class b on a.toast = b.oid where a.relkind = 'r' and a.relnamespace = 2200 and a.relnatts = 3""",
)
def catalog_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    c = catalogs(spark, sf)
    number = F.col("attnum")
    full = c["pg_attribute"].withColumns({
        "atttypid": F.when(number == 2, 25).otherwise(23), "attlen": F.when(number == 2, -1).otherwise(4), "attalign": F.lit("i"),
        "attisdropped": F.lit(False), "atthasmissing": (F.col("attrelid") % 2 == 1) & (number == 1),
    })
    d = catalog.descriptors(catalog.tables(c["pg_class"], c["pg_namespace"]), c["pg_class"], full, c["pg_index"])
    shown = F.array_join(F.transform("columns", lambda x: F.concat_ws(":", x["attname"], x["atttypid"].cast("string"))), ",")
    return d.select("oid", "relname", "relfilenode", "toast_filenode", shown.alias("columns"), F.array_join("pk", ",").alias("pk"), "has_fast_defaults")


@register("catalog_incomplete", f"with {SQL_CLASS} select oid, relname from pg_class where relnatts <> 3")
def catalog_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    c = catalogs(spark, sf)
    return catalog.incomplete(c["pg_class"], c["pg_attribute"]).select("oid", "relname")


@register("attach_candidates", f"with {SQL_CLASS} select oid, relname from pg_class where relkind = 'r' and relnamespace = 2200 and s_suppkey % 3 <> 0 and s_suppkey % 10 <> 1")
def attach_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = catalogs(spark, sf)
    s = table(spark, sf, "supplier")
    tracked, failed = s.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 16384).alias("oid")), s.where("s_suppkey % 10 = 1").select(F.col("s_name").alias("relname"))
    return catalog.attachable(catalog.tables(c["pg_class"], c["pg_namespace"]), tracked, failed).select("oid", "relname")


@register(
    "catalog_reconcile",
    """select s_suppkey + 16384 as oid, case when s_suppkey % 9 <> 0 then s_name end as old_name, case when s_suppkey % 8 <> 0 then s_name || case when s_suppkey % 5 = 0 then 'x' else '' end end as new_name,
    case when s_suppkey % 8 = 0 then 'vanished' when s_suppkey % 9 = 0 then 'new' when s_suppkey % 7 = 0 then 'rewritten' when s_suppkey % 6 = 0 then 'columns' when s_suppkey % 5 = 0 then 'renamed' else 'same' end as change
    from supplier where s_suppkey % 8 <> 0 or s_suppkey % 9 <> 0""",
)
def catalog_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    s, key = table(spark, sf, "supplier"), F.col("s_suppkey")
    old = s.where("s_suppkey % 9 <> 0").select((key + 16384).alias("oid"), F.col("s_name").alias("relname"), key.alias("relfilenode"), F.array(F.lit("a")).alias("columns"))
    fresh = s.where("s_suppkey % 8 <> 0").select((key + 16384).alias("oid"), F.concat("s_name", F.when(key % 5 == 0, "x").otherwise("")).alias("relname"), F.when(key % 7 == 0, key + 1).otherwise(key).alias("relfilenode"), F.when(key % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("columns"))
    return catalog.reconciled(old, fresh)


@register("record_routing", "select event_id, user_id % 40 as relfilenode, 't' || (user_id % 40) as table_name from events where user_id % 40 < 20")
def record_routing(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "events").select("event_id", (F.col("user_id") % 40).alias("relfilenode"))
    tracked = spark.range(20).select(F.col("id").alias("relfilenode"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("table_name"))
    return catalog.routed(records, tracked).select("event_id", "relfilenode", "table_name")


@register("gap_tables", "select s_suppkey as oid, s_suppkey * 3 as watermark from supplier where s_suppkey * 3 > 0 and s_suppkey * 3 < 150")
def gap_tables(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.gaps(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("oid"), (F.col("s_suppkey") * 3).alias("watermark")), 150)


@register("vacuum_candidates", "select 'part-' || o_orderkey || '.parquet' as path from orders where o_orderkey % 1000 < 500 and not exists (select 1 from customer where c_custkey = o_orderkey)")
def vacuum_candidates(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string"), F.lit(".parquet")).alias("path")
    listing = table(spark, sf, "orders").select(name("o_orderkey"), (F.col("o_orderkey") % 1000).alias("modified_ms"))
    return catalog.lost_files(listing, table(spark, sf, "customer").select(name("c_custkey")), 500).select("path")


# --- scalar columns ------------------------------------------------------------------------------


@register("lsn_text", "select event_id, printf('%X/%X', (event_id * 123456789) >> 32, (event_id * 123456789) & 4294967295) as lsn, event_id * 123456789 as back from events")
def lsn_text(spark: SparkSession, sf: str) -> DataFrame:
    text = X.lsn_text(F.col("event_id") * 123_456_789)
    return table(spark, sf, "events").select("event_id", text.alias("lsn"), X.parse_lsn(text).alias("back"))


@register("ctid_pack", "select o_orderkey, (o_custkey << 16) | (o_orderkey % 300) as ctid, o_custkey as block, cast(o_orderkey % 300 as bigint) as off from orders")
def ctid_pack(spark: SparkSession, sf: str) -> DataFrame:
    packed = table(spark, sf, "orders").select("o_orderkey", X.pack_ctid(F.col("o_custkey"), F.col("o_orderkey") % 300).alias("ctid"))
    return packed.select("o_orderkey", "ctid", X.ctid_block(F.col("ctid")).alias("block"), X.ctid_offset(F.col("ctid")).alias("off"))


@register("uuid_text", "select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as uuid from (select event_id, md5(event_id::varchar) as h from events)")
def uuid_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", X.uuid_text(F.unhex(F.md5(F.col("event_id").cast("string").cast("binary")))).alias("uuid"))


@register("bytea_hex", "select c_custkey, lower(hex(encode(c_name))) as hex from customer")
def bytea_hex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", X.bytea_hex(F.col("c_name").cast("binary")).alias("hex"))
