"""Resampling, exact search and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from meritlake.llm import importance, ordering, periodic, topk
from meritlake.llm import queries as q

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "   ", "a", "a " * 400, "Ab-é\x1c a1 日本 " * 30, "word " * 30 + "other", "x y z " * 50, "x y z " * 50]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, 9, 1.5, "r") for k, t in enumerate(TEXTS)] + [(None, "no id " * 40, 9, 1.5, "r"), (7, "x y z " * 50, 9, 1.5, "r"), (-10, "tie " * 25, 9, 1.5, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, score double, runs string")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_top_k_search"])
def test_query_is_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    rows = sorted(map(repr, map(tuple, df.collect())))
    assert rows == sorted(map(repr, con.execute(f"select {', '.join(df.columns)} from ({q.ORACLE[name]})").fetchall()))


# resampling


def plain_resampling(rows, target, percent, longest, buckets, min_words, seed):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    found = lambda t: [zlib.crc32(" ".join(words(t)[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words(t)) - n + 1)]
    s, t = Counter(b for _, x in rows for b in found(x)), Counter(b for x in target for b in found(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for d, x in rows:
        fs = found(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("percent", "longest"), [(10, 1), (50, 2), (100, 3), (0, 1)])
def test_resampling_on_odd_rows(spark, odd, percent, longest):
    rows, target = [(r["doc_id"], r["text"]) for r in odd.collect()], ["x é tie", None, "日本 other"]
    got = importance.resampled(odd, spark.createDataFrame([(t,) for t in target], "text string"), percent, longest, 97, 20, 5)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(rows, target, percent, longest, 97, 20, 5)


def test_resampling_of_nothing(spark, odd):
    none = odd.where("false")
    assert importance.resampled(none, odd).count() == 0
    assert {r["rank"] for r in importance.resampled(odd, none, percent=100).collect()} >= {1, 2, None}


def test_row_at_any_place_of_a_table_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 1, 1, rng.randrange(1000)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "score long, id long")
    order = [df["score"].desc(), df["id"].asc()]
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for place in (1, 2, 299, 1500, 2999, 3000):
        assert tuple(ordering.row_at(df, "score", order, place, accuracy=20).values()) == want[place - 1]
    assert ordering.row_at(df, "score", order, 0) is None and ordering.row_at(df, "score", order, 3001) is None
    assert [tuple(r) for r in ordering.placed(df, order, "place").orderBy("place").collect()] == [(*r, k + 1) for k, r in enumerate(want)]


# search


def plain_search(rows, k, every, scale):
    held = lambda x: math.floor(max(-topk.LARGEST / scale, min(topk.LARGEST / scale, x)) * scale)
    able = [(n, d, [held(x) for x in v]) for n, (d, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, d, v in able:
        if d is not None and d % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), e is None, e or 0, m) for m, e, u in able if m != n)[:k]
            out += [(d, r + 1, None if missing else e, -s) for r, (s, missing, e, _) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = random.Random(seed)
    dims, n, size = [(17, 300, 0.3), (1, 30, 1e5), (8, 5, 1e300), (3, 200, 0.01)][seed]
    pool = [[rng.gauss(0, 1) * size for _ in range(rng.choice([dims, dims, dims - 1]))] for _ in range(n // 2 + 1)]
    rows = [(rng.choice([None, *range(-20, 2 * n)]), rng.choice([pool[0], pool[0], rng.choice(pool)])) for _ in range(n)]
    rows += [(0, None), (20, [math.nan] * dims), (40, [None] * dims), (60, [math.inf] * dims), (20, pool[0]), (20, pool[0])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, score string, q int")
    assert sorted(map(tuple, topk.top_k(df, k=5).collect()), key=repr) == plain_search(rows, 5, 20, 64)
    assert topk.top_k(df.where("false")).count() == 0


# runs


def plain_runs(w, least, periods):
    found = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, periods * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_random_texts(spark):
    rng, texts = random.Random(1), []
    for _ in range(300):
        k, n = rng.choice([1, 2, 3, 5, 50]), rng.randrange(260)
        w = [str(rng.randrange(k)) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(n) if n else 0
            p = 1 + rng.randrange((n - a) // 3 + 1)
            for i in range(a, min(n, a + p * rng.randrange(3, 9))):
                w[i] = w[a + (i - a) % p]
        texts.append(" ".join(w))
    texts += ["a b " * 2000, "x " * 20_000, " ".join(str(k % 4000) for k in range(15_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in periodic.periodic_runs(df).collect():
        w = texts[r["doc_id"]].split()
        got = [tuple(x) for x in r["runs"]]
        if len(w) < 1000:
            assert got == plain_runs(w, 24, 3)
        assert r["collapsed"] == plain_collapsed(w, got) and r["n_words"] == len(w)
    long = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(df.where("doc_id >= 300")).collect()}
    assert long == {300: [(0, 4000, 2)], 301: [(0, 20_000, 1)], 302: [(0, 15_000, 4000)]}


def test_runs_of_thue_morse_words_are_checked_word_by_word():
    w = np.array([bin(k).count("1") % 2 for k in range(1 << 13)])
    assert len(periodic.maximal_runs(w, np.zeros(len(w), dtype=np.int64))) == 0  # it holds no cube
    assert [tuple(r) for r in periodic.maximal_runs(np.tile(w[:64], 5), np.zeros(320, dtype=np.int64))] == [(0, 320, 64)]


def test_runs_query(spark, odd, tmp_path):
    odd.drop("rank", "score", "runs").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = q.op13_periodic_runs(spark, str(tmp_path)).unionByName(q.op13_periodic_runs(spark, SF)).collect()
    want = []
    for d, t in texts:
        w = [x.decode() for x in (t or "").encode().split()]
        h = 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w, 24, 3)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(plain_collapsed(w, runs))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in want) and periodic.periodic_runs(odd.where("false")).count() == 0
