"""Dismissals and restorations: the same as one by one, and trackings are met once."""

from __future__ import annotations

from pyspark.sql import functions as F

from meritlake.operators import writing
from meritlake.plans import domain as d
from meritlake.plans import queries_more

SF = "/root/testdata/sf0.001"


def _one_by_one(was: dict, requests: list, known: set) -> list:
    state = {k: [v, 0, 0, 0] for k, v in was.items()}
    for user, opp, _, dismiss in sorted(requests, key=lambda r: r[2]):
        row = state.setdefault((user, opp), [None, 0, 0, 0])
        if dismiss and opp in known:
            row[0], row[1] = True, row[1] + 1
        elif not dismiss and row[0]:
            row[0], row[2] = False, row[2] + 1
        else:
            row[3] += 1
    return sorted((*k, *v) for k, v in state.items())


def test_same_as_one_by_one(spark):
    was = {(u, o): (u + o) % 2 == 0 for u in range(4) for o in range(5) if (u + o) % 3}
    requests = [(n % 4, n * n % 7, n, n % 5 in (0, 3)) for n in range(120)]
    old = spark.createDataFrame([(*k, v) for k, v in was.items()], "user_id long, opp_id long, is_dismissed boolean")
    asked = spark.createDataFrame(requests, "user_id long, opp_id long, seq long, dismiss boolean")
    got = writing.dismissals(old, asked, spark.range(4).select(F.col("id").alias("opp_id")))
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(_one_by_one(was, requests, set(range(4))), key=key)


def test_lines_are_read_once_and_lose_what_orders_them(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries_more.dismissals(spark, SF)._jdf.queryExecution().executedPlan().toString()
        moved = d.trackings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("lineitem" in line for line in plan.split("\n") if "FileScan" in line) == 1
    top = moved[: moved.index("SortMergeJoin")]
    assert "o_custkey" in top and "l_suppkey" not in top
