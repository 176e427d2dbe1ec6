"""Queries take whole tables, whatever their size."""

import random

from pagelake.operators import timetravel
from pagelake.plans import registry


def test_time_travel_takes_whole_tables(spark, sf):
    q = registry.queries()
    rows = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").count()
    assert q["timetravel_resolve"](spark, sf).count() == q["branch_resolve"](spark, sf).count() == rows("events")
    assert q["gc_redundant"](spark, sf).count() == rows("orders")


def test_time_travel_equals_brute_force(spark):
    rng = random.Random(3)
    span = lambda: (a := rng.randrange(60), a + rng.randrange(9))
    frags = [(rng.randrange(3), *span(), rng.randrange(100)) for _ in range(60)]
    asked = [(i, rng.randrange(4), rng.randrange(70), rng.randrange(100)) for i in range(300)]
    f = spark.createDataFrame(frags, "rel long, start long, end long, lsn long")
    want = {}
    for i, rel, block, at in asked:
        over = [x[3] for x in frags if x[0] == rel and x[1] <= block < x[2]]
        want[i] = (max((x for x in over if x <= at), default=None), bool(over))
    for bucket in (4, 1024):
        got = timetravel.bases(spark.createDataFrame(asked, "request long, rel long, block long, read_lsn long"), f, bucket).collect()
        assert len(got) == len(asked) and {r.request: (r.base, r.covered) for r in got} == want
    ranges = [(i, rng.randrange(4), *span()) for i in range(200)]
    good = {(x[0], b) for x in frags if 20 <= x[3] <= 90 for b in range(x[1], x[2])}
    want = {i: all((rel, b) in good for b in range(a, e)) for i, rel, a, e in ranges}
    for bucket in (4, 1024):
        got = timetravel.image_redundant(spark.createDataFrame(ranges, "range long, rel long, start long, end long"), f, 20, 90, bucket).collect()
        assert len(got) == len(ranges) and {r.range: r.redundant for r in got} == want


def test_chains_of_any_customer_have_statuses(spark, tmp_path):
    keys = [0, 1, 2, 3, 49_997, 49_998, 60_001, 60_002, 60_003, 168_161_795]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = set()
    for k in keys:
        for v in range(k % 4 + 1):
            if (10 + 4 * k + v) % 5 and not (v < k % 4 and (11 + 4 * k + v) % 5):
                want.add((k, v))
                break
    assert {tuple(r) for r in registry.queries()["hot_chain_emit"](spark, str(tmp_path)).collect()} == want
