"""What the corpus operators share: intermediate tables, text columns, word rules, group streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlake.sources.tables import discard, shared_dir, written

__all__ = ["discard", "shared_dir", "written"]

#: Rows in an Arrow batch; texts are large, so batches are kept small.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as whole texts travel in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns (doc_id, text) of docs; a null text counts as an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def least_hashed(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """A sample: the n rows with the least hash of cols among those of a share of the hashes that holds about 2 n rows.

    The share keeps what each task sends for the choice in proportion to n, not to n times the tasks. Where many rows share
    cols, so that the share holds less than half of n, all hashes count.
    """
    share, h = max(1, df.count() // (2 * n)), F.xxhash64(*cols)
    some = df.where(F.pmod(h, F.lit(share)) == 0)
    if share > 1 and some.limit(-(-n // 2)).count() < n / 2:
        some = df
    return some.orderBy(h, *cols).limit(n)


def by_batch(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """df through work, one Arrow batch at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Join sorted batches into tables that hold whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            new[0] = any(np.asarray(last.column(k))[0] != c[0] for k, c in zip(keys, cols, strict=True))
        else:
            new[0] = True
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(batch)
            continue
        cut = int(starts[-1])
        if cut or held:
            head = [*held, batch.slice(0, cut)] if cut else held
            if head:
                yield pa.Table.from_batches(head)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(*cols: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbouring rows begin, with the row count at the end."""
    n = len(cols[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n members' component under links a-b."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(was, root):
            return root
