"""Costs and loans: what a course costs, what is funded, and what the rest costs as a loan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYMENTS = 120


def planned_totals(trackings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(user_id, planned): the awards of each user's planned trackings; a null award counts nothing."""
    awards = opportunities.select("opp_id", "award")
    return trackings.where("is_planned").join(awards, "opp_id").groupBy("user_id").agg(F.sum(F.coalesce("award", F.lit(0))).cast("long").alias("planned"))


def plan(users: DataFrame, budgets: DataFrame, planned: DataFrame) -> DataFrame:
    """One plan for each user: sums, unfunded need, a ten-year loan for it, cushions and how far funding covers them.

    A user without a budget gets an empty one of four years at 7.5 percent.
    """
    joined = users.select("user_id").join(budgets, "user_id", "left").join(planned, "user_id", "left")
    none = {"direct": 0, "living": 0, "income": 0, "program_years": 4, "interest_rate": 7.5, "planned": 0}
    filled = joined.select("user_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])
    base = filled.withColumns({"expenses": (F.col("direct") + F.col("living")).cast("long"), "funding": F.col("planned") + F.col("income"), "rate": F.col("interest_rate") / 100.0 / 12.0})
    base = base.withColumn("unfunded", F.greatest(F.lit(0), F.col("expenses") - F.col("funding")))
    base = base.withColumn("debt", F.col("unfunded") * F.col("program_years")).withColumn("factor", F.pow(1 + F.col("rate"), F.lit(PAYMENTS)))
    payment = F.when((F.col("debt") > 0) & (F.col("rate") > 0), F.col("debt") * (F.col("rate") * F.col("factor")) / (F.col("factor") - 1)).when(F.col("debt") > 0, F.col("debt") / PAYMENTS).otherwise(0.0)
    paid = base.withColumn("payment", payment)
    cents = lambda c, n=2: F.round(c.cast("decimal(20,8)"), n).cast("double")
    return paid.select(
        "user_id", F.col("direct").cast("long").alias("direct"), F.col("living").cast("long").alias("living"), "expenses", F.col("income").cast("long").alias("income"), "planned", "unfunded", "debt",
        cents(F.col("payment")).alias("monthly_payment"),
        cents(F.greatest(F.lit(0.0), F.col("payment") * PAYMENTS - F.col("debt"))).alias("lifetime_interest"),
        (F.col("expenses") * 3).alias("cushion_3x"), (F.col("expenses") * 5).alias("cushion_5x"),
        F.when(F.col("expenses") > 0, cents(F.col("funding") / (F.col("expenses") * 3) * 100, 1)).otherwise(0.0).alias("cushion_percent"),
    )
