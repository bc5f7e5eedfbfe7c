"""Every query of the engine against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import json
import math
import os

import duckdb
import pytest

from meritlake.plans.oracle import ORACLE
from meritlake.plans.oracle_more import ORACLE_MORE
from meritlake.plans.oracle_web import ORACLE_WEB
from meritlake.plans.queries import QUERIES as FIRST
from meritlake.plans.queries_more import QUERIES_MORE

SF = "/root/testdata/sf0.001"
SQL = ORACLE | ORACLE_WEB | ORACLE_MORE
QUERIES = FIRST | QUERIES_MORE
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    found = con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    assert ours == sorted((tuple(map(plain, r)) for r in found), key=repr)
    assert ours


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_crawl_report_has_the_best_candidates(spark):
    best = sorted(QUERIES["C11_crawl_run"](spark, SF).select("url", "title", "relevance", "action").collect(), key=lambda r: -r["relevance"])
    got = [json.loads(r["report"]) for r in QUERIES["K14_crawl_report"](spark, SF).collect()]
    assert [x["relevance"] for x in got] == [r["relevance"] for r in best[:20]]
    assert {(x["url"], x["title"], x["action"]) for x in got} <= {(r["url"], r["title"], r["action"]) for r in best}


def test_whole_feeds_go_on_past_the_tenth(spark):
    assert all(QUERIES[n](spark, SF).where("rank > 10").count() for n in ("C03_whole_feed", "C04_whole_tiered_feed"))


def test_repair_finds_the_source_of_each_brand_that_a_supplier_has(spark):
    from meritlake.plans import domain

    got = QUERIES["C17_repair_urls"](spark, SF).where("action = 'source'").join(domain.opportunities(spark, SF).select("opp_id", "provider"), "opp_id")
    assert {"brand#5", "brand#7", "brand#9"} <= {r[0].lower() for r in got.select("provider").distinct().collect()}
