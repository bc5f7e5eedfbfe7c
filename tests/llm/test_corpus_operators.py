"""Chat, exact and near repeats, decontamination and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meritlake.llm import chat, compact_windows, latent, simhash, suffixes, toxicity, words
from meritlake.llm import queries as q

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "a", "word " * 300, "x" * 900, "\x1c  é\n\n日本 語", "tie tie tie", "tie tie tie"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "s", 3) for k, t in enumerate(ODD)] + [(None, "no id", "s", 3), (3, "a", "s", 3)], "doc_id long, text string, spans string, d int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


# chat


def test_chat_query_is_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df = q.op8_chat_formatting(spark, SF)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(con.execute(f"select {', '.join(df.columns)} from ({q.ORACLE['op8_chat_formatting']})").fetchall())


def test_texts_come_back_from_any_control_strings(spark):
    texts = ["", None, "<|im_end|>", "<\\|im_end|>", "a<|im_end|>\n<|im_start|>assistant\nb", "<\\\\|", "x\n<|", "|>", "\\n"]
    rows = [(k, t, r, x) for k in range(2) for t, (r, x) in enumerate(zip(["user", "assistant", "a\nb", "\\n", "<|im_end|>", None, "assistant", "user", "\\\\n\n"], texts, strict=True))]
    made = chat.read_back(chat.format_paths(chat.as_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    for r in made.collect():
        want = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss_text"] == "".join(t for role, t in want if role == "assistant")
    assert chat.format_paths(chat.as_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_cycles_end_and_repeated_nodes_count_once_and_whole(spark):
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 2, "user", "below the cycle", 1.0), (1, 4, 4, "user", "its own parent", 1.0)]
    rows += [(1, 10, None, "user", "root", 1.0), (1, 11, 10, "assistant", "leaf", 1.0), (2, 1, None, "user", "x", 1.0), (2, 1, None, "assistant", "yy", 5.0)]
    tree = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, node long, parent long, role string, text string, score double, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(tree, best=9)).collect()}
    assert set(got) == {1, 2} and [tuple(t) for t in got[1]["turns"]] == [("user", "root"), ("assistant", "leaf")]
    assert (tuple(got[2]["turns"][0]), got[2]["score"]) in [(("user", "x"), 1.0), (("assistant", "yy"), 5.0)]


def test_paths_of_a_tree(spark):
    rng = random.Random(2)
    nodes = [(1, k, None if k == 0 else rng.randrange(k), "user", f"t{k}", float(k % 3)) for k in range(60)] + [(2, 5, 99, "user", "orphan", None)]
    tree = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    up, score = {n[1]: n[2] for n in nodes if n[0] == 1}, {n[1]: n[5] for n in nodes if n[0] == 1}
    want = {}
    for leaf in set(up) - {p for p in up.values() if p is not None}:
        path = [leaf]
        while up[path[0]] is not None:
            path.insert(0, up[path[0]])
        want[leaf] = (path, sum(score[x] for x in path))
    got = defaultdict(list)
    for r in chat.best_paths(tree, best=1000).where("conv_id = 1").collect():
        got[r["leaf"], r["path_score"]].append((r["at"], r["node"]))
    assert {leaf: ([n for _, n in sorted(at)], score) for (leaf, score), at in got.items()} == want
    assert all([k for k, _ in sorted(at)] == list(range(1, len(at) + 1)) for at in got.values())
    best = chat.format_paths(tree, best=2).where("conv_id = 1").orderBy("branch").collect()
    assert [r["leaf"] for r in best] == sorted(want, key=lambda x: (-want[x][1], -len(want[x][0]), x))[:2]


def test_long_conversation_and_rows_of_no_tree(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    steps = chat.best_paths(chat.as_tree(turns))
    assert steps.agg(F.count(F.lit(1)), F.min(F.col("at") == F.col("node")), F.max("at")).first()[:] == (n, True, n)
    lost = spark.createDataFrame([(None, 0, "user", "a", 5), (7, 0, "user", "b", 5)], "conv_id long, turn long, role string, text string, leaf int")
    made = chat.format_paths(chat.as_tree(lost)).collect()
    assert [(r["conv_id"], r["formatted"]) for r in made] == [(7, "<|im_start|>user\nb<|im_end|>\n")]


# exact repeats


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def copies(rng, n):
    base = ["".join(rng.choices("abcd \n", k=rng.randint(0, 700))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(base) for _ in range(rng.randint(0, 3))] + ["".join(rng.choices("abé", k=rng.randint(0, 90)))]
        text = "".join(p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)] for p in parts)
        if text and rng.random() < 0.5:
            k = rng.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        out.append(text)
    return [*out, *out[:5], "z" * 500, None, ""]


@pytest.mark.parametrize(("length", "gram", "most"), [(100, 16, 4096), (60, 32, 4096), (100, 16, 1)])
def test_exact_repeats(spark, length, gram, most):
    texts = copies(random.Random(length), 60)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = rows.select("doc_id", F.col("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    spans = defaultdict(list)
    for r in suffixes.repeated_spans(keyed.select("d", "k", "text"), length, gram, most).collect():
        spans[r["d"]].append((r["s"], r["e"]))
    for k, want in enumerate(plain_repeats(texts, length)):
        got = suffixes.merged(spans[k])
        assert (sum(e - s for s, e in got), len(got)) == want[1:3], k
    if most > 1:
        got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.without_repeats(rows, length, gram).collect()}
        assert [got[k] for k in range(len(texts))] == plain_repeats(texts, length)


def test_exact_repeats_of_odd_rows(odd, none):
    rows = suffixes.without_repeats(odd).collect()
    assert len(rows) == odd.count() and {r["doc_id"]: r["n_removed"] for r in rows}[5] == 900
    assert suffixes.without_repeats(none).count() == 0


def test_slices_change_nothing():
    text = "".join(random.Random(4).choices("ab", k=5000)).encode()
    whole = {w for _, _, a, b, _ in suffixes.phrases(text, 100, 16) for w in range(a, b + 1)}
    parts = [w for _, _, a, b, _ in suffixes.phrases(text, 100, 16, step=700) for w in range(a, b + 1)]
    assert sorted(parts) == sorted(whole) == list(range(len(text) - 99))


# near repeats


def test_near_repeated_passages(spark, odd, none):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    fresh = lambda n: rng.choices(words, k=n)
    passage, other = fresh(80), fresh(70)
    edited = passage.copy()
    edited[40] = "CHANGED"
    texts = {k: fresh(30) + (passage if k % 4 == 0 else edited if k % 4 == 1 else other if k % 4 == 2 else fresh(60)) + fresh(25) for k in range(40)}
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(rows).collect()}
    for k in texts:
        spans = [tuple(map(int, s.split(":"))) for s in got[k]["spans"].split(",") if s]
        if k % 4 == 3:
            assert spans == [] and got[k]["partner"] is None
        else:
            ((s, e),) = spans
            n = 70 if k % 4 == 2 else 80
            assert abs(s - 30) <= 6 and abs(e - 30 - n) <= 6 and got[k]["partner"] is not None
    assert compact_windows.repeated_passages(odd).count() == odd.count() and compact_windows.repeated_passages(none).count() == 0


def test_windows_cover_each_passage_once():
    h = np.random.default_rng(1).integers(0, 2**62, 60).astype(np.uint64)
    nodes = list(zip(*(x.tolist() for x in compact_windows.windows(h, np.array([0, 25, 30, 60]), 7)), strict=True))
    for lo, hi in ((0, 25), (25, 30), (30, 60)):
        for a in range(lo, hi):
            own = [c for l, c, r in nodes if l <= a <= r]
            if a + 7 > hi:
                assert own == []
            else:
                assert len(own) == 1 and h[own[0]] == h[a : a + 7].min() and a <= own[0] < a + 7


def test_words_are_hashed_alike_wherever_they_stand():
    texts = ["One  two\tTHREE", "", "  ", "two", "é one\x0b日本 two ", "three"]
    column = pa.array(["skipped", *texts]).slice(1)
    seen = {}
    for a, b, data, bounds in words.parts(column):
        hashes, begins = words.word_hashes(data, bounds)
        for k in range(a, b):
            own = texts[k].encode().lower().split()
            got = hashes[begins[k - a] : begins[k - a + 1]].tolist()
            assert len(got) == len(own)
            for w, h in zip(own, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) == 5


def test_recall_of_repeated_passages(spark):
    """Against brute force: exact passages of 50 words are all found, those of Jaccard 0.8 to 0.95 but for a few; also where all texts share a line."""
    rng = random.Random(3)
    known = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    fresh = lambda n: rng.choices(known, k=n)
    line, texts, due = fresh(35), {}, []
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(300):
        passage = fresh(rng.choice([50, 50, 60, 90]))
        if k % 3 == 0:
            passage[5:25] = line[:20]  # its least shingles may be common ones
        other = passage.copy()
        if k % 2:
            for _ in range(1 + (len(passage) > 80)):
                other[rng.randrange(len(other))] = "changed" + str(k)
        a, b = grams(passage), grams(other)
        if len(a & b) >= 0.8 * len(a | b):
            due.append((2 * k, 2 * k + 1, k % 2))
        for n, p in ((2 * k, passage), (2 * k + 1, other)):
            texts[n] = fresh(rng.randint(20, 60)) + line + fresh(rng.randint(0, 30)) + p + fresh(rng.randint(0, 40))
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeated"] for r in compact_windows.repeated_passages(rows).collect()}
    exact = [got[a] >= 50 and got[b] >= 50 for a, b, near in due if not near]
    near = [got[a] >= 45 and got[b] >= 45 for a, b, near in due if near]
    assert len(exact) == 150 and all(exact)
    assert len(near) > 100 and sum(near) >= 0.9 * len(near)
    alone = spark.createDataFrame([(k, " ".join(fresh(60) + line + fresh(60))) for k in range(40)], "doc_id long, text string")
    assert compact_windows.repeated_passages(alone).where("n_repeated > 0").count() == 0


def test_near_repeats_among_decoys(spark):
    """60 pairs of 60-word passages with a changed word, and 60 that are equal; 40 other texts for each hold the passage's first or last 25 words."""
    rng = random.Random(11)
    known = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(6000)]
    fresh = lambda n: rng.choices(known, k=n)
    texts = []
    for p in range(120):
        passage = fresh(60)
        other = passage.copy()
        if p < 60:
            other[rng.randrange(25, 35)] = f"changed{p}"
        texts += [fresh(20) + passage + fresh(20), fresh(20) + other + fresh(20)]
        texts += [fresh(20) + passage[:25] + fresh(55) if n < 20 else fresh(55) + passage[-25:] + fresh(20) for n in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = spark.createDataFrame([(order[n], " ".join(w)) for n, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeated"] for r in compact_windows.repeated_passages(rows).collect()}
    both = [got[order[42 * p]] >= 45 and got[order[42 * p + 1]] >= 45 for p in range(120)]
    assert sum(both[:60]) >= 54 and all(both[60:])
    assert not any(got[order[42 * p + n]] for p in range(120) for n in range(2, 42))


def test_joint_signatures_are_of_all_functions():
    s = np.random.default_rng(2).integers(0, 2**62, 90).astype(np.uint64)
    s[60:90] = s[10:40]
    ends = np.array([0, 50, 60, 90])
    key, l, r = compact_windows.joint(s, ends, 20)
    starts = [a for lo, hi in zip(ends[:-1], ends[1:], strict=True) for a in range(lo, hi - 19)]
    assert sorted(a for x, y in zip(l, r, strict=True) for a in range(x, y + 1)) == sorted(starts * compact_windows.BANDS)
    at = {(band, a): key[i] for band, (i0, i1) in enumerate(_runs(l)) for i in range(i0, i1) for a in range(l[i], r[i] + 1)}
    assert all(at[band, a] == at[band, a - 50] for band in range(compact_windows.BANDS) for a in range(60, 71))
    assert not len(compact_windows.joint(s[:10], np.array([0, 10]), 20)[0])


def test_places_where_windows_overlap():
    rng = random.Random(6)
    at = lambda lo, r: lo << 16 | 3 << 8 | (r - lo + 20)
    for _ in range(50):
        windows = [(a, a + rng.randrange(15)) for a in (rng.randrange(200) for _ in range(rng.randrange(1, 20)))]
        due = {p for p in range(300) if sum(a <= p <= r for a, r in windows) >= compact_windows.OVERLAPS}
        got = compact_windows.overlapped([at(a, r) for a, r in windows], 20)
        assert {p for lo, hi in got for p in range(lo, hi)} == {q for p in due for q in range(p, p + 20)}


def _runs(l):
    begins = [0, *(np.flatnonzero(np.diff(l) < 0) + 1).tolist(), len(l)]
    return list(zip(begins[:-1], begins[1:], strict=True))


def test_repeated_rows_are_repeated_as_a_whole(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(1, long), (2, long), (None, long), (3, "short one"), (4, "short one")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_repeated"], r["partner"]) for r in compact_windows.repeated_passages(rows).collect())
    assert got == [(0, 60, 1), (1, 60, 2), (2, 60, 1), (3, 0, None), (4, 0, None)]


# decontamination


def test_leaks(spark, odd, none):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(12, 55)))) for k in range(30)] + [(90, "too short"), (91, None), (None, "x")]
    rows, want = [], set()
    for k in range(300):
        text = rng.choices(words, k=rng.randint(20, 300))
        if k % 10 == 0:
            i = k // 10
            said = items[i][1].split()
            if k % 20 == 0 and len(said) > 20:
                said[7:7] = ["inserted"]
                del said[3]
            text[15:15] = said
            want.add((k, i))
        rows.append((k, " ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, benchmark).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want  # recall against what was planted; nothing else
    assert latent.leaks(none, benchmark).count() == 0 and latent.leaks(odd, benchmark).count() == 0 and latent.leaks(docs, benchmark.where("false")).count() == 0


def test_leaks_of_items_in_a_third_of_the_rows(spark):
    rng = random.Random(16)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(2000)]
    items = [(k, " ".join(rng.choices(words, k=20))) for k in range(3)] + [(3, "five words are enough here"), (4, "the of and to a in is it the of")]
    rows, want = [], set()
    for k in range(300):
        text = rng.choices(words, k=60) + ["the", "and", "of", "to", "a", "in", "is", "it"]
        rng.shuffle(text)
        for i in [0] * (k % 3 == 0) + [1] * (k % 50 == 1) + [3] * (k % 40 == 2) + [4] * (k % 60 == 5):
            text[20:20] = items[i][1].split()
            want.add((k, i))
        rows.append((k, " ".join(text)))
    found = latent.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_leaks_of_long_and_short_items_with_words_put_in(spark):
    rng = random.Random(26)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(6000)]
    items = [(k, " ".join(rng.choices(words, k=200 if k < 10 else 10))) for k in range(40)]
    rows, want = [], set()
    for k in range(200):
        text = rng.choices(words, k=80)
        if k % 2 == 0 and k < 80:  # a word after every second one, so no run of three is left
            said = items[k // 2][1].split()
            text[30:30] = [x for i, w in enumerate(said) for x in ((w, f"new{i}") if i % 2 and k < 20 else (w,))]
            want.add((k, k // 2))
        rows.append((k, " ".join(text)))
    rows.append((900, " ".join(t for _, t in items[10:])))
    want |= {(900, k) for k in range(10, 40)}
    found = {(r["doc_id"], r["item_id"], r["cosine"] is not None) for r in latent.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {x[:2] for x in found} == want
    assert sum(x[2] for x in found) >= 0.9 * len(want)  # found by vectors, not by runs of words alone


def test_leaks_against_all_pairs(spark):
    """Each document with each item: the longest common subsequence around every place of the document."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    coded = {}
    code = lambda t: np.array([coded.setdefault(w, len(coded)) for w in latent.words_of(t or "")], dtype=np.int32)
    texts, wanted = {r["doc_id"]: code(r["text"]) for r in docs.collect()}, {r["item_id"]: code(r["text"]) for r in items.collect()}
    due = set()
    for d, text in texts.items():
        have = Counter(text.tolist())
        for i, item in wanted.items():
            n = len(item)
            if n < latent.MIN_WORDS or sum(min(c, have[w]) for w, c in Counter(item.tolist()).items()) < latent.LIKELY * n:
                continue  # no subsequence can be that long
            if max(latent.common_length(item, text[s : s + n + n // 4]) for s in range(0, max(1, len(text) - n // 2), max(1, n // 8))) >= latent.LIKELY * n:
                due.add((d, i))
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in latent.leaks(docs, items).collect()}
    assert due and due <= set(got)
    assert all(share >= latent.POSSIBLY for share in got.values())


def test_common_length():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [[rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert latent.common_length(np.array(a, dtype=int), np.array(b, dtype=int)) == best[-1][-1]


# pipeline


def test_near_copies_against_plain_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    odd = [(None, "a text without an id that stands alone here"), (rows[0][0], "another text under an id that is taken"), (rows[0][0], rows[0][1]), (None, rows[1][1])]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"lang": F.lit("x"), "component_id": F.lit(1)})
    fps = [(simhash.fingerprint(t or ""), d, t) for d, t in rows + odd]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][0] ^ fps[b][0]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    first = {}
    for g, (_, d, _) in zip(group, fps, strict=True):
        first.setdefault(g, []).append((d is None, d or 0))
    got = corpus_pipeline.drop_near_copies(spark, table, SF)
    assert got.columns == table.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted(min(x) for x in first.values())


def test_rows_without_an_id_are_scored(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest table has no such row
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bad = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1 and held_out").collect()}
    table = docs.unionByName(docs.where(F.col("doc_id").isin(*bad)).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(spark.createDataFrame([(None, "plain words")], docs.schema))
    kept = corpus_pipeline.drop_toxic(spark, table, sf).collect()
    assert bad and not bad & {r["doc_id"] for r in kept} and [r["text"] for r in kept if r["doc_id"] is None] == ["plain words"]
    assert {r["held_out"] for r in toxicity.scored(table, labels).where("doc_id is null").collect()} == {False}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    now, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, now = now, stage(spark, now, SF)
        assert now.columns == docs.columns and now.select("doc_id").distinct().count() == now.count(), name
        ids.append({r[0] for r in was.select("doc_id").collect()} - {r[0] for r in now.select("doc_id").collect()})
        now = now.cache()
    assert not ids[3]
    left = {r["doc_id"] for r in now.collect()}
    packed = corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()
    assert {r[0] for r in packed} == left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_pipeline_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r[0] for r in docs.select("doc_id").collect()}
    kept = lambda stage: {r[0] for r in stage(spark, docs, SF).select("doc_id").collect()}
    classes = simhash.near_duplicates(docs).collect()
    assert kept(corpus_pipeline.drop_near_copies) == {r["component_id"] for r in classes}
    leaked = {r[0] for r in latent.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()}
    assert leaked and kept(corpus_pipeline.drop_leaks) == every - leaked
    train = toxicity.train_rows(spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r[0] for r in toxicity.scored(docs, train=train.join(docs.select("doc_id"), "doc_id")).where("predicted = 1").select("doc_id").collect()}
    assert kept(corpus_pipeline.drop_toxic) == every - toxic
