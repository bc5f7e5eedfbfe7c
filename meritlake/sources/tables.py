"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meritlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing of it."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: So many rows at most are broadcast by hint.
FEW = 600_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, marked to be broadcast if it has at most so many rows; more of them are left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A row's place within its task is in so many lower bits of the number that Spark gives it.
_IN_TASK = 33


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df, written, with numbers from 0 on without gaps for the rows of each key; only the sizes of tasks by key meet in the driver."""
    held = written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("_row", _IN_TASK)
    sizes = held.groupBy(*keys, task.alias("_task")).agg(F.count(F.lit(1)).alias("n")).collect()
    before: dict[tuple, int] = {}
    starts = []
    for r in sorted(sizes, key=lambda r: r["_task"]):
        key = tuple(r[k] for k in keys)
        starts.append((*key, r["_task"], before.get(key, 0)))
        before[key] = before.get(key, 0) + r["n"]
    if not starts:
        return held.select(*df.columns, F.lit(0).cast("long").alias(name))
    offsets = df.sparkSession.createDataFrame(starts, df.select(*keys).schema.add("_task", "long").add("_before", "long"))
    within = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy("_row")) - 1
    return held.withColumn("_task", task).join(F.broadcast(offsets), [*keys, "_task"]).withColumn(name, F.col("_before") + within).select(*df.columns, name)


def discard(df: DataFrame) -> None:
    """Remove what written() wrote for df, once all that reads it has been written itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
