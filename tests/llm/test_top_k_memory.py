"""What goes through the driver in the search by inner product."""

from __future__ import annotations

import numpy as np

from meritlake.llm import topk


def test_queries_of_all_deals_are_not_broadcast(spark):
    slices = spark.range(40).selectExpr("id as block", "cast(0 as int) as part", "cast(1 as int) as width", "cast(1 as int) as n", "cast(null as binary) as ids", "cast(null as binary) as least", "cast(null as binary) as data")
    asking = spark.range(3).selectExpr("id as qblock", "cast(0 as int) as part", "cast(1 as int) as qwidth", "cast(1 as int) as qn", "cast(null as binary) as qdata")
    met = topk._met(slices, asking, 16)
    assert met.count() == 120
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_met_whole_and_one_at_a_time(spark):
    entries = np.zeros(1, dtype=topk._ENTRY).tobytes()
    rows = [(b, q, p, entries) for p in range(2) for q in range(7) for b in range(5)]
    df = spark.createDataFrame(rows, topk._ENTRIES)

    def work(parts):
        assert len({(r["block"], r["qblock"]) for r in parts}) == 1
        yield parts[0] | {"part": len(parts)}

    out = topk._by_tile(df, work, topk._ENTRIES).collect()
    assert sorted((r["block"], r["qblock"], r["part"]) for r in out) == sorted((b, q, 2) for b in range(5) for q in range(7))
    assert "ObjectHashAggregate" not in topk._by_tile(df, work, topk._ENTRIES)._jdf.queryExecution().executedPlan().toString()
