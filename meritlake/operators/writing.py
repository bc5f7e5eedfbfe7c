"""Changes to tables, as new tables: upserts, inserts, updates and erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: str, strict: bool = False, judged: list[str] | None = None) -> DataFrame:
    """The table after an upsert of incoming by keys, with action: created, updated, unchanged, or kept for rows that nothing came for.

    Of rows with equal keys the last by order counts. An upsert changes all columns but the keys that incoming has; a row
    is unchanged if they are the same (strict: a row that came is always updated; judged: the columns that this goes by).
    """
    values = [c for c in incoming.columns if c not in keys and c != order]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("new"))
    old = current.withColumn("there", F.lit(True))
    both = old.join(last, keys, "full_outer")
    same = F.lit(not strict)
    for c in values if judged is None else judged:
        same = same & F.col(c).eqNullSafe(F.col(f"new.{c}"))
    action = F.when(F.col("new").isNull(), "kept").when(F.col("there").isNull(), "created").when(same, "unchanged").otherwise("updated")
    rest = [F.col(c) for c in current.columns if c not in keys and c not in values]
    return both.select(*keys, *[F.when(F.col("new").isNull(), F.col(c)).otherwise(F.col(f"new.{c}")).alias(c) for c in values], *rest, action.alias("action"))


def insert_new(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of incoming whose key the table does not have, the first by order of each key."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c != key]), order).alias("row")).select(key, "row.*")
    return first.join(current.select(key), key, "left_anti")


def fill_update(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after changes by key that set what they have and leave what they have as null; new keys are added."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key])
    named = [c for c in changes.columns if c != key]
    return current.join(new, key, "full_outer").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in named else F.col(c) for c in current.columns])


def without_users(tables: dict[str, DataFrame], users: DataFrame, key: str = "user_id") -> dict[str, DataFrame]:
    """Each table without the rows of users."""
    gone = users.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def inserted(current: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows added; columns that rows do not have are null."""
    return current.unionByName(rows, allowMissingColumns=True)


def insert_unseen(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of incoming whose key the table does not have, equal keys within incoming each."""
    return incoming.join(current.select(key).distinct(), key, "left_anti")


def patched(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after changes (key, fields map<string, string>) that set exactly the fields they name, to null as well; unknown keys change nothing."""
    out = current.join(changes.select(key, "fields"), key, "left")
    kinds = dict(current.dtypes)
    named = lambda c: F.coalesce(F.map_contains_key("fields", F.lit(c)), F.lit(False))
    return out.select(*[F.col(c) if c == key else F.when(named(c), F.try_element_at("fields", F.lit(c)).cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in current.columns])


def dismissals(trackings: DataFrame, requests: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(user_id, opp_id, is_dismissed, n_dismissed, n_restored, n_not_found) after requests (user_id, opp_id, seq, dismiss) in order of seq.

    A dismissal of an opportunity that there is makes or changes the tracking; of another it is not found. What undoes a
    dismissal that is not there is not found either. Whether one is there depends on the request before alone; only the
    first request of a pair needs the tracking, so requests are counted first and meet trackings once.
    """
    known = requests.join(opportunities.select("opp_id", F.lit(True).alias("known")), "opp_id", "left")
    pair = ["user_id", "opp_id"]
    # a request that counts leaves is_dismissed as it says, or false, as it was; a dismissal of what is not there leaves nothing
    counts = F.coalesce("known", F.lit(False)) | ~F.col("dismiss")
    before_it = F.last(F.when(counts, F.col("dismiss")), ignorenulls=True).over(Window.partitionBy(*pair).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    steps = known.withColumns({"counts": counts, "prior": before_it})
    restores = F.col("counts") & ~F.col("dismiss")
    found = F.col("counts") & (F.col("dismiss") | F.coalesce("prior", F.lit(False)))
    each = steps.groupBy(*pair).agg(
        F.max_by("dismiss", F.when(found, F.col("seq"))).alias("now"), F.count_if(F.col("counts") & F.col("dismiss")).alias("n_dismissed"), F.count_if(restores & F.col("prior")).alias("n_restored"),
        F.count_if(~F.col("counts") | (restores & ~F.col("prior"))).alias("n_not_found"), F.count_if(restores & F.col("prior").isNull()).alias("n_first"),
    )
    both = trackings.select(*pair, F.col("is_dismissed").alias("was")).join(each, pair, "full_outer")
    first, undone = F.coalesce("n_first", F.lit(0)), F.coalesce("was", F.lit(False))
    n = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        *pair, F.coalesce("now", F.when((first > 0) & undone, F.lit(False)), "was").alias("is_dismissed"), n("n_dismissed").alias("n_dismissed"),
        (n("n_restored") + F.when(undone, first).otherwise(0)).alias("n_restored"), (n("n_not_found") + F.when(undone, 0).otherwise(first)).alias("n_not_found"),
    )


def deleted(trackings: DataFrame, requests: DataFrame) -> DataFrame:
    """trackings without those of requests (user_id, opp_id); a request by another user removes nothing."""
    return trackings.join(requests.select("user_id", "opp_id").distinct(), ["user_id", "opp_id"], "left_anti")
