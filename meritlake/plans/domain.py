"""The engine's tables, derived from the given ones by fixed formulas: profiles, opportunities, trackings, budgets and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Results never depend on the wall clock.
AS_OF = "1998-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile for each customer."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(
        "c_custkey as user_id",
        "c_name as full_name",
        "case when c_custkey % 7 <> 0 then concat('u', c_custkey, '@example.org') end as email",
        "c_custkey % 2 = 0 as marketing_opt_in",
        """case c_mktsegment when 'AUTOMOBILE' then array('pharmacy') when 'BUILDING' then array('Medicine (MD)') when 'FURNITURE' then array('nursing')
             when 'HOUSEHOLD' then array('Physical Therapy', 'nursing') else cast(array() as array<string>) end as disciplines""",
        "case when c_custkey % 3 = 0 then 'diagnostic_imaging' end as primary_discipline",
        "case c_custkey % 5 when 0 then array('PharmD') when 1 then array('MD', 'DO') when 2 then array('rn') else cast(array() as array<string>) end as target_credentials",
        "case when c_custkey % 4 = 0 then 'RN' end as target_credential",
        "case c_custkey % 7 when 0 then 'P2' when 1 then ' Residency' when 2 then 'graduate' when 3 then 'High School' when 4 then 'gap year' when 5 then '' end as clinical_phase",
        "case when c_custkey % 11 <> 0 then 2.0D + (c_custkey % 21) / 10.0D end as gpa",
        "case when c_custkey % 13 <> 0 then n_name end as state",
        "case c_custkey % 6 when 0 then 'cbsa:16980' when 1 then 'New York-Newark-Jersey City' when 2 then 'seattle' when 3 then ' Boise ' when 4 then '' end as metro",
        "case when c_custkey % 7 <> 0 then cast(floor(c_acctbal) as int) end as sai",
        "c_custkey % 3 = 0 as first_gen",
        "c_custkey % 4 = 0 as minority",
        "case c_custkey % 4 when 0 then array('APhA', 'ASHP') when 1 then array('ama') else cast(array() as array<string>) end as affiliations",
        "case when c_custkey % 5 = 0 then 'premium' else 'free' end as tier",
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opportunity for each part."""
    none = "cast(array() as array<string>)"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as opp_id",
        "p_name as title",
        "p_brand as provider",
        "concat('https://www.', lower(replace(p_brand, '#', '')), '.example.org/awards/', p_partkey) as portal_url",
        "cast(floor(p_retailprice) as int) as award",
        "date_add(date'1998-01-01', cast(p_partkey % 365 as int)) as deadline",
        f"""case split(p_type, ' ')[0] when 'ECONOMY' then array('pharmacy') when 'STANDARD' then array('Medicine') when 'SMALL' then array('nursing')
             when 'MEDIUM' then array('therapeutics_rehab', 'nursing') when 'LARGE' then array('ANY') else {none} end as disciplines""",
        f"case p_partkey % 6 when 0 then array('PharmD', 'RN') when 1 then array('MD') else {none} end as credentials",
        f"case p_partkey % 5 when 0 then array('Undergraduate', 'graduate') when 1 then array('doctoral') else {none} end as levels",
        "case when p_size % 3 = 0 then 0.0D else 2.0D + (p_size % 20) / 10.0D end as min_gpa",
        "case when p_partkey % 4 = 0 then cast((p_partkey % 10) * 1000 as int) end as max_sai",
        f"case p_partkey % 3 when 0 then array('FRANCE', 'germany', 'CHINA') when 1 then array('JAPAN', 'BRAZIL') else {none} end as states",
        f"case p_partkey % 7 when 0 then array('chicago', 'cbsa:42660') when 1 then array('NYC', 'new york-newark-jersey city', 'boise') else {none} end as metros",
        f"case p_partkey % 9 when 0 then array('ASHP') when 1 then array('apha', 'ASHP') else {none} end as required_affiliations",
        f"case when p_partkey % 2 = 0 then array('First_Gen') when p_partkey % 5 = 0 then {none} else array('minority', 'AMA') end as tags",
        "case when p_partkey % 5 = 0 then 'low' when p_partkey % 8 <> 0 then 'medium' end as competition",
        "case when p_partkey % 19 <> 0 then p_partkey % 17 = 0 end as is_archived",
        "p_partkey % 10 = 0 as has_service_commitment",
        "p_partkey % 15 = 0 as employment_required",
        "date_add(date'1998-01-01', cast(p_partkey % 151 as int)) as created_on",
    )


def trackings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tracking for each customer and part that met in an order: the latest line stands for all.

    The lines of an order are settled before they meet its customer, where their columns are left behind; each value goes
    on by itself and at a fixed width, so that a query moves only those it reads.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    flagged = lines.selectExpr("l_orderkey", "l_partkey", "l_returnflag = 'R' as dismissed", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").repartition("l_orderkey")
    last = flagged.groupBy("l_orderkey", "l_partkey").agg(F.expr("max_by(dismissed, struct(l_linenumber, l_suppkey, l_extendedprice, l_quantity)) as dismissed"))
    coded = orders.selectExpr("o_orderkey", "o_custkey", "case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end as code", "cast(o_orderdate as date) as day")
    latest = last.join(coded, last.l_orderkey == coded.o_orderkey).groupBy("o_custkey", "l_partkey").agg(*[F.max_by(c, "o_orderkey").alias(c) for c in ("dismissed", "code", "day")])
    return latest.selectExpr(
        "o_custkey as user_id",
        "l_partkey as opp_id",
        "dismissed as is_dismissed",
        "case code when 2 then 'submitted' when 1 then 'in_progress' else case when o_custkey % 4 = 0 then 'archived' else 'saved' end end as status",
        "(o_custkey + l_partkey) % 3 = 0 as is_planned",
        "day as created_on",
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One budget for each customer but every tenth, who has none yet."""
    return table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").selectExpr(
        "c_custkey as user_id",
        "cast(10000 + (c_custkey % 40) * 1000 as int) as direct",
        "cast(8000 + (c_custkey % 17) * 500 as int) as living",
        "cast((c_custkey % 9) * 2500 as int) as income",
        "cast(1 + c_custkey % 6 as int) as program_years",
        "cast(c_custkey % 10 as double) as interest_rate",
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl seed for each page address without its fragment."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "regexp_replace(trim(url), '#.*$', '') as url").groupBy("url").agg(F.min("page_id").alias("page_id")).selectExpr(
        "url",
        "case when page_id % 4 = 0 then 'crawled' when page_id % 9 = 0 then 'failed' else 'queued' end as status",
        "cast(page_id % 3 as int) as priority",
        "cast(page_id % 5 as int) as error_count",
        "case when page_id % 4 = 0 then date_sub(date'1998-06-01', cast(page_id % 15 as int)) end as last_crawled_on",
    )
