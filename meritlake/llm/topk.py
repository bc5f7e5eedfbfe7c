"""Exact top-k by inner product: vectors cut into parts, each part's score lists threshold by threshold, the rest looked up."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritlake.llm.base import by_batch, small_batches, written

#: Vectors of a block, and of a block of queries; what a task holds at once grows with their product.
BLOCK, QUERY_BLOCK = 4096, 512
#: Parts of a vector. Each is a node that sees its own components only.
PARTS = 2
#: The first lists are so many times longer than what is asked for, which brings the first cutoff near the last one.
DEPTH = 5
#: Components are held to this size, so that every score fits a long.
LARGEST = 1 << 26
#: The cutoff of a query with too few candidates.
NO_CUT = -(1 << 62)

_ENTRY = np.dtype([("q", "<u2"), ("v", "<u2"), ("s", "<i8")])
_BLOCKS = "block long, part int, width int, n int, ids binary, least binary, data binary"
_ENTRIES = "block long, qblock long, part int, entries binary"


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, row, key, v): floor(scale * x) of each component; key stands for equal v. Null vectors and those with null or non-finite components are left out."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    held = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-LARGEST / scale), F.least(F.lit(LARGEST / scale), c)) * scale).cast("long"))
    rows = vectors.where(x.isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), held.alias("v"))
    return rows.withColumn("key", F.md5(F.array_join(F.transform("v", lambda c: c.cast("string")), ",").cast("binary")))


def blocks_of(classes: DataFrame, dims: int, rows: int, blocks: int) -> DataFrame:
    """_BLOCKS rows of (cls, least, v): for each block of vectors and part, the part's components in the narrowest integers that hold them."""
    cuts = [dims * p // PARTS for p in range(PARTS + 1)]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, []

        def emit(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            lists = table.column("v").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            whole = np.zeros((table.num_rows, dims), dtype=np.int64)  # missing components count as 0
            whole[np.arange(dims) < size[:, None]] = lists.flatten().to_numpy()
            out = []
            for p in range(PARTS):
                mine = whole[:, cuts[p] : cuts[p + 1]]
                width = next(w for w in (1, 2, 4, 8) if not mine.size or np.abs(mine).max() < 1 << (8 * w - 1))
                out.append(((task << 24) + made, p, width, table.num_rows, table.column("cls").to_numpy().astype("<i8").tobytes(), table.column("least").to_numpy().astype("<i8").tobytes(), mine.astype(f"<i{width}").tobytes()))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                whole = pa.Table.from_batches(held)
                yield emit(whole.slice(0, rows))
                held = whole.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            yield emit(pa.Table.from_batches(held))

    return classes.select("cls", "least", "v").repartition(blocks).mapInArrow(packed, _BLOCKS)


def _matrix(row: dict, prefix: str) -> np.ndarray:
    return np.frombuffer(row[f"{prefix}data"], dtype=f"<i{row[f'{prefix}width']}").reshape(row[f"{prefix}n"], -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products of rows, exact: in floats as long as every sum is a whole number that they hold."""
    bound = q.shape[1] * float(np.abs(q.astype(np.int64)).max(initial=0)) * float(np.abs(v.astype(np.int64)).max(initial=0))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return q.astype(kind) @ v.T.astype(kind)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _by_row(df: DataFrame, work, schema: str) -> DataFrame:
    """df through work, a generator of rows (dicts) for each row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for out in work(batch.slice(k, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_pylist([out], schema=kinds).select(names)

    kinds = _arrow(schema)
    return df.mapInArrow(run, schema)


def _met(slices: DataFrame, asking: DataFrame, deals: int) -> DataFrame:
    """Each block of vectors with each block of queries of the same part: vectors are dealt, queries go to every deal.

    Spark takes queries for as large as they are before they are repeated, and would broadcast all deals' through the driver; so
    the hint has both sides shuffled, and a task holds the vectors of its deals.
    """
    there = slices.drop("ids", "least").withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(deals)).cast("int"))
    every = asking.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return there.hint("shuffle_hash").join(every, ["part", "deal"]).drop("deal")


def first_lists(met: DataFrame, length: int) -> DataFrame:
    """The best length entries of each query in each block, part by part."""

    def work(row: dict) -> Iterator[dict]:
        s = products(_matrix(row, "q"), _matrix(row, ""))
        n = min(length, s.shape[1])
        v = np.argpartition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :]
        out = np.empty(v.size, dtype=_ENTRY)
        out["q"], out["v"], out["s"] = np.repeat(np.arange(len(s)), n), v.ravel(), np.take_along_axis(s, v, axis=1).ravel()
        yield {"block": row["block"], "qblock": row["qblock"], "part": row["part"], "entries": out.tobytes()}

    return _by_row(met, work, _ENTRIES)


def above_threshold(met: DataFrame) -> DataFrame:
    """All entries of at least the uniform threshold, the query's cutoff divided by the parts. What reaches the cutoff in all reaches it in one part."""

    def work(row: dict) -> Iterator[dict]:
        s = products(_matrix(row, "q"), _matrix(row, ""))
        least = np.frombuffer(row["cut"], dtype="<i8") // PARTS
        q, v = np.nonzero(s >= least[:, None])
        out = np.empty(len(q), dtype=_ENTRY)
        out["q"], out["v"], out["s"] = q, v, s[q, v]
        if len(out):
            yield {"block": row["block"], "qblock": row["qblock"], "part": row["part"], "entries": out.tobytes()}

    return _by_row(met, work, _ENTRIES)


def _by_tile(entries: DataFrame, work, schema: str) -> DataFrame:
    """entries through work, a generator of rows for each tile's rows (dicts). Tiles are sorted, which Spark does on disk where need be, and met one at a time."""
    tile = ["block", "qblock"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and any(held[0][c] != row[c] for c in tile):
                    yield from made(held)
                    held = []
                held.append(row)
        if held:
            yield from made(held)

    def made(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for out in work(rows):
            yield pa.RecordBatch.from_pylist([out], schema=kinds).select(names)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = _arrow(schema)
    return entries.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, schema)


def _summed(parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair numbers, sum of what is known, which parts are, as bits) of one tile's entries."""
    held = [(np.frombuffer(p["entries"], dtype=_ENTRY), 1 << p["part"]) for p in parts]
    pair = np.concatenate([(e["q"].astype(np.int64) << 32) | e["v"] for e, _ in held])
    pairs, at = np.unique(pair, return_inverse=True)
    total, seen = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
    np.add.at(total, at, np.concatenate([e["s"] for e, _ in held]))
    np.bitwise_or.at(seen, at, np.concatenate([np.full(len(e), bit) for e, bit in held]))
    return pairs, total, seen


def totals(entries: DataFrame, slices: DataFrame, asking: DataFrame, keep: int) -> DataFrame:
    """(qblock, q, block, v, least, cls, total): whole scores of what is listed in any part, the best keep of each query and block.

    A part in which a pair is not listed is asked for its score, unless even the threshold there would leave the pair below the
    query's cutoff. asking has cut if there are cutoffs.
    """
    cuts = asking.where("part = 0").select("qblock", *([F.col("cut")] if "cut" in asking.columns else [F.lit(None).cast("binary").alias("cut")]))

    def missing(rows: list[dict]) -> Iterator[dict]:
        pairs, total, seen = _summed(rows)
        able = np.ones(len(pairs), dtype=bool)
        if rows[0]["cut"] is not None:
            cut = np.frombuffer(rows[0]["cut"], dtype="<i8")[pairs >> 32]
            unseen = PARTS - sum((seen >> p) & 1 for p in range(PARTS))
            able = total + unseen * (cut // PARTS) >= cut
        for p in range(PARTS):
            if (mine := able & ((seen >> p) & 1 == 0)).any():
                yield {"block": rows[0]["block"], "qblock": rows[0]["qblock"], "part": p, "entries": pairs[mine].tobytes()}

    def looked_up(row: dict) -> Iterator[dict]:
        pairs = np.frombuffer(row["entries"], dtype="<i8")
        q, v = _matrix(row, "q"), _matrix(row, "")
        out = np.empty(len(pairs), dtype=_ENTRY)
        out["q"], out["v"] = pairs >> 32, pairs & 0xFFFFFFFF
        for k in range(0, len(pairs), 1 << 16):
            some = out[k : k + (1 << 16)]
            some["s"] = (q[some["q"]].astype(np.int64) * v[some["v"]].astype(np.int64)).sum(axis=1)
        yield {"block": row["block"], "qblock": row["qblock"], "part": row["part"], "entries": out.tobytes()}

    def nearest(rows: list[dict]) -> Iterator[dict]:
        """What has a whole score, reaches the cutoff and may be among the best keep of its query, ties included."""
        pairs, total, seen = _summed(rows)
        full = seen == (1 << PARTS) - 1
        if rows[0]["cut"] is not None:
            full &= total >= np.frombuffer(rows[0]["cut"], dtype="<i8")[pairs >> 32]
        pairs, total = pairs[full], total[full]
        if not len(pairs):
            return
        q = pairs >> 32
        order = np.lexsort((-total, q))
        q, total = q[order], total[order]
        first = np.searchsorted(q, q)
        last = np.minimum(first + keep, np.searchsorted(q, q, side="right")) - 1
        top = total >= total[last]
        out = np.empty(top.sum(), dtype=_ENTRY)
        out["q"], out["v"], out["s"] = q[top], (pairs & 0xFFFFFFFF)[order][top], total[top]
        yield {"block": rows[0]["block"], "qblock": rows[0]["qblock"], "part": 0, "entries": out.tobytes()}

    asked = _by_tile(entries.join(cuts, "qblock"), missing, _ENTRIES)
    both = asked.join(asking.select("qblock", "part", "qwidth", "qn", "qdata"), ["qblock", "part"]).join(slices.select("block", "part", "width", "n", "data"), ["block", "part"])
    whole = _by_tile(entries.unionByName(_by_row(both, looked_up, _ENTRIES)).join(cuts, "qblock"), nearest, _ENTRIES)
    names = slices.where("part = 0").select("block", "ids", "least")

    def best(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for row in batch.to_pylist():
            e = np.frombuffer(row["entries"], dtype=_ENTRY)
            q, v, total = e["q"].astype(np.int64), e["v"], e["s"]
            least, ids = np.frombuffer(row["least"], dtype="<i8")[v], np.frombuffer(row["ids"], dtype="<i8")[v]
            order = np.lexsort((ids, least, -total, q))
            q, total, least, ids = q[order], total[order], least[order], ids[order]
            first = np.searchsorted(q, q)
            top = np.arange(len(q)) - first < keep
            out.append((np.full(top.sum(), row["qblock"]), q[top].astype(np.int32), least[top], ids[top], total[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qblock", "q", "least", "cls", "total"]) if len(cols[0]) else None

    return by_batch(whole.join(names, "block"), best, "qblock long, q int, least long, cls long, total long")


def with_cutoffs(asking: DataFrame, found: DataFrame, wanted: int) -> DataFrame:
    """asking with cut: for each query of a block the wanted-th best of the whole scores found so far, which the final ones cannot fall below."""
    nth = F.row_number().over(Window.partitionBy("qblock", "q").orderBy(F.desc("total")))
    cuts = found.select("qblock", "q", "total", nth.alias("nth")).where(F.col("nth") <= wanted).where(F.col("nth") == wanted)
    listed = cuts.groupBy("qblock").agg(F.collect_list(F.struct("q", "total")).alias("cuts"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.select(["qn", "cuts"]).to_pylist():
            cut = np.full(row["qn"], NO_CUT, dtype="<i8")
            for c in row["cuts"] or []:
                cut[c["q"]] = c["total"]
            out.append(cut.tobytes())
        return batch.drop_columns(["cuts"]).append_column("cut", pa.array(out, pa.binary()))

    return by_batch(asking.join(listed, "qblock", "left"), work, "qblock long, part int, qwidth int, qn int, qids binary, qdata binary, cut binary")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by every, by inner product of integer vectors.

    Each part of the components is a node with score lists of its own. First the parts' best entries are gathered and their
    whole scores give each query a safe cutoff; it goes to all parts, divided by their number, and they give all entries that
    reach it; scores that are missing then are looked up, unless bounds rule the pair out. Equal vectors are searched as one,
    with the k + 1 smallest ids of its rows, as no query needs more.

    Ties go to the smaller id, null ids last. A row is no candidate for itself, but a row that repeats its id is one. Null
    vectors and those with null or non-finite components take no part; shorter vectors count as filled with zeros, and
    components are held to +-2**26. A null id is no query. An empty table, or one row, gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(integer_vectors(vectors, scale, id_col, vec_col), "vectors")
    last = F.coalesce("id", F.lit((1 << 63) - 1))
    grouped = rows.groupBy("key").agg(F.min(last).alias("least"), F.first("v").alias("v"))
    classes = written(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n, dims = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims, asked = max(dims, PARTS), rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-n // BLOCK))
    slices = written(blocks_of(classes, dims, BLOCK, blocks), "blocks")
    askers = classes.join(asked.select("key").distinct(), "key", "left_semi")
    asking = written(blocks_of(askers, dims, QUERY_BLOCK, max(1, -(-askers.count() // QUERY_BLOCK))), "queries")
    asking = asking.select(F.col("block").alias("qblock"), "part", F.col("width").alias("qwidth"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    deals = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = written(first_lists(_met(slices, asking.drop("qids"), deals), -(-DEPTH * (k + 1) // blocks)), "lists")
    cut = written(with_cutoffs(asking, totals(lists, slices, asking, k + 1), k + 1), "cutoffs")
    entries = written(above_threshold(_met(slices, cut.drop("qids"), deals)), "entries")
    found = totals(entries, slices, cut, k + 1)

    # classes become rows: of the best classes of a query their k + 1 smallest ids, of these the best k + 1
    nth = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = found.withColumn("nth", nth(["qblock", "q"], F.desc("total"), "least", "cls")).where(F.col("nth") <= k + 1)
    members = rows.withColumn("nth", nth(["key"], F.asc_nulls_last("id"), "row")).where(F.col("nth") <= k + 1).join(classes.select("key", "cls"), "key").select("cls", "id", "row")
    each = best.join(members, "cls").withColumn("nth", nth(["qblock", "q"], F.desc("total"), F.asc_nulls_last("id"), "row")).where(F.col("nth") <= k + 1)
    lists = each.groupBy("qblock", "q").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "row", "total"))).alias("found"))

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, dtype="<i8") for x in batch.column("qids").to_pylist()]
        cols = [np.repeat(batch.column("qblock").to_numpy(), [len(x) for x in ids]), np.concatenate([np.arange(len(x), dtype=np.int32) for x in ids]), np.concatenate(ids)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qblock", "q", "cls"])

    of_class = by_batch(asking.where("part = 0").select("qblock", "qids"), named, "qblock long, q int, cls long").join(classes.select("cls", "key"), "cls").select("qblock", "q", "key")
    # many rows may ask with one vector: its list is split among as many keys as there are thousands of them
    many = asked.groupBy("key").agg(F.floor(F.count(F.lit(1)) / 1000).cast("int").alias("shares"))
    answers = lists.join(of_class, ["qblock", "q"]).join(many, "key").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares"))))
    hot = F.broadcast(many.where("shares > 0").orderBy(F.desc("shares"), "key").limit(10_000))  # at most so many keys; the others' rows meet in one task each, 1000 times their shares at most
    share = F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("shares") + 1)).cast("int")
    askers = asked.select("id", "row", "key").join(hot, "key", "left").withColumn("share", share).withColumnRenamed("row", "own").drop("shares")
    others = F.slice(F.filter("found", lambda f: f["row"] != F.col("own")), 1, k)
    out = askers.join(answers.select("key", "share", "found"), ["key", "share"]).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.total").alias("score"))
