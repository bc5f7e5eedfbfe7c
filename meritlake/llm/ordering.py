"""Order over whole tables without one task for all rows: places in a total order, and the row at a place."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.llm.base import discard, written

#: A row's place within its task is in the lower bits of the number that Spark gives it.
_IN_TASK = 33


def placed(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """df with each row's place in the order, from 1. order must tell rows apart, or else equal ones stand in any order.

    Rows are dealt by ranges of the order and sorted within them; only the number of rows of each range meets in the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("_row", _IN_TASK)
    sizes = dict(numbered.groupBy(task.alias("task")).count().collect())
    before = [0, *accumulate(sizes.get(k, 0) for k in range(max(sizes, default=0) + 1))]
    offset = F.expr(f"get(array({', '.join(f'{n}L' for n in before)}), cast(shiftright(_row, {_IN_TASK}) as int))")
    out = numbered.withColumn(place, offset + F.col("_row").bitwiseAND(F.lit((1 << _IN_TASK) - 1)) + 1).drop("_row")
    out.written_to = numbered.written_to
    return out


def row_at(df: DataFrame, score: str, order: list[Column], place: int, accuracy: int = 1000) -> dict | None:
    """The row at a place (from 1) in an order that begins with score falling; null if there are not so many rows.

    A quantile sketch gives a bracket of scores; the rows above it are counted exactly, which shows whether the row lies
    within it, and the bracket is widened until it does. Only the rows of the bracket are sorted.
    """
    n, least, most = df.agg(F.count(F.lit(1)), F.min(score), F.max(score)).first()
    if not 1 <= place <= n:
        return None
    width = 2.0 / accuracy
    while True:
        at = 1 - (place - 0.5) / n
        low, high = df.agg(F.percentile_approx(score, [max(0.0, at - width), min(1.0, at + width)], accuracy)).first()[0]
        low, high = (least if at - width <= 0 else low), (most if at + width >= 1 else high)
        above, within = df.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score).between(low, high))).first()
        if above < place <= above + within:
            break
        width *= 4
    inside = placed(df.where(F.col(score).between(low, high)), order, "_place")
    found = inside.where(F.col("_place") == place - above).drop("_place").first().asDict()
    discard(inside)
    return found
