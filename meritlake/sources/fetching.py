"""Fetching as a data source: a bounded number of readers at a time, a row for each address, errors as rows.

What HTTP would answer is a stand-in: stored responses (url, code, html), html as bytes. Addresses and responses are dealt
to buckets by a hash of the address; a reader takes its buckets one after the other, so it holds the addresses of one
bucket at a time and goes through that bucket's responses in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meritlake.sources.tables import folder

FORMAT, FETCHED = "bounded_fetch", "url string, html string, error string"
#: Readers at a time, addresses in a bucket on average, addresses looked at between two batches of rows.
CONCURRENCY, BUCKET_ROWS, BATCH_ROWS = 5, 100_000, 1024


class Share(InputPartition):
    """The buckets of one reader."""

    def __init__(self, buckets: list[int]) -> None:
        super().__init__(None)
        self.buckets = buckets


def answer(code: int | None, html: bytes | None, least: int = 1) -> tuple[str | None, str | None]:
    """(html, error) of a response: unreachable without a code, http N from 400 on, undecodable if it is no UTF-8, empty if nothing is in it."""
    if code is None:
        return None, "unreachable"
    if code >= 400:
        return None, f"http {code}"
    try:
        text = (html or b"").decode("utf-8")
    except UnicodeDecodeError:
        return None, "undecodable"
    return (text, None) if len(text.strip()) >= least else (None, "empty")


class BoundedReader(DataSourceReader):
    """Rows of FETCHED for all addresses below a path, by at most so many readers."""

    def __init__(self, path: str, buckets: int, concurrency: int) -> None:
        self.path, self.buckets, self.concurrency = path.rstrip("/"), buckets, concurrency

    def partitions(self) -> list[Share]:
        n = max(1, min(self.concurrency, self.buckets))
        return [Share(list(range(k, self.buckets, n))) for k in range(n)]

    def _table(self, name: str, bucket: int) -> ds.Dataset | None:
        where, path = fs.FileSystem.from_uri(f"{self.path}/{name}/bucket={bucket}")
        if where.get_file_info(path).type == fs.FileType.NotFound:
            return None
        return ds.dataset(path, filesystem=where, format="parquet")

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for bucket in partition.buckets:
            asked = self._table("asked", bucket)
            if asked is None:
                continue
            waiting = dict.fromkeys(asked.to_table(columns=["url"])["url"].to_pylist())
            rows = [(u, None, "blank") for u in waiting if not (u or "").strip()]
            for u, _, _ in rows:
                del waiting[u]
            there = self._table("responses", bucket)
            for batch in there.to_batches(columns=["url", "code", "html"], batch_size=BATCH_ROWS) if there else ():
                for u, code, html in zip(*(batch.column(c).to_pylist() for c in ("url", "code", "html")), strict=True):
                    if u in waiting:
                        del waiting[u]
                        rows.append((u, *answer(code, html)))
                yield self._batch(rows)
                rows = []
            yield self._batch(rows + [(u, None, "unreachable") for u in waiting])

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["url", "html", "error"])


class BoundedFetch(DataSource):
    """Options: path (with asked and responses in buckets), buckets, concurrency."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> BoundedReader:
        return BoundedReader(self.options["path"], int(self.options["buckets"]), int(self.options.get("concurrency", CONCURRENCY)))


def fetched(wanted: DataFrame, responses: DataFrame, concurrency: int = CONCURRENCY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """FETCHED of each distinct url of wanted, by at most concurrency readers at a time.

    responses: (url, code, html as binary); of several for an address the one with the least code, then the first html
    counts, and one without a code comes last. error is null for a page that came, else blank, unreachable, http N,
    undecodable or empty; an address that fails leaves the others alone.
    """
    spark: SparkSession = wanted.sparkSession
    path = folder(spark, "fetching")
    urls = wanted.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    n = max(concurrency, -(-urls.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("url"), F.lit(n)).cast("int").alias("bucket")
    one = responses.where("url is not null").groupBy("url").agg(F.min(F.struct(F.col("code").isNull().alias("late"), F.col("code").cast("int").alias("code"), "html")).alias("r"))
    for name, df in (("asked", urls.select("url", bucket)), ("responses", one.join(urls, "url", "left_semi").select("url", "r.code", "r.html", bucket))):
        df.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
    spark.dataSource.register(BoundedFetch)
    return spark.read.format(FORMAT).option("path", path).option("buckets", n).option("concurrency", concurrency).load()
