"""Hard negatives, periodic runs and removal of repeated passages: plain versions, hostile inputs and the registered queries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vodmill.llm import negatives, queries, runs, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("low", "high", "d"), [(-256, 255, 64), (0, 3, 5), (-5, -1, 7), (-(1 << 20), 1 << 20, 33), (-(1 << 28), 1 << 28, 16), (0, 0, 4)])
def test_packed_products_are_exact(low, high, d):
    rng = np.random.default_rng(d)
    a, r = rng.integers(low, high + 1, (7, d)), rng.integers(low, high + 1, (23, d))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in r] for u in a]
    assert negatives.packed_products(a, r).tolist() == want
    assert negatives.packed_products(a[:0], r).shape == (0, 23) and negatives.packed_products(a, r[:0]).shape == (7, 0)
    assert not negatives.packed_products(a[:, :0], r[:, :0]).any()


def test_several_candidates_share_a_wide_integer():
    """Unit vectors in 256ths: each multiplication serves two candidates at least."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 64))
    whole = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    bias = -int(whole.min())
    width = (int(np.abs(whole).sum(axis=1).max()) * (int(whole.max()) + bias)).bit_length() + 1
    assert negatives.EXACT // width >= 2


def test_products_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        negatives.packed_products(np.full((1, 4), 1 << 45), np.full((1, 4), 1 << 45))


def plain_negatives(rows, k=5, most=5):
    rows = {i: (lab, np.floor(256 * np.asarray(v, np.float64)).astype(np.int64)) for i, lab, v in rows}
    out = []
    for a in sorted(i for i in rows if i % 100 == 0):
        lab, v = rows[a]
        scored = sorted(((-int(v @ w), i) for i, (_, w) in rows.items() if i != a and len(w) == len(v)))
        pos = [(i, -s) for s, i in scored if rows[i][0] == lab][:k]
        for p, ps in pos:
            neg = [(i, -s) for s, i in scored if rows[i][0] != lab and 80 * ps <= -100 * s <= 100 * ps][:most]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(neg)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>"
ORDER = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 100 == 0).select(*ORDER).collect()))


def test_negatives_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        v = rng.normal(size=8) + (2.5 if i % 3 else -0.5)
        rows.append((i, 1 if i % 3 else int(rng.integers(4)), [float(x) for x in np.float32(v / np.linalg.norm(v))]))  # a label with two thirds of all rows
    rows += [(2000 + i, 2, rows[7][2]) for i in range(60)]  # ties
    rows += [(3000 + i, i % 2, [0.5, -0.25]) for i in range(30)] + [(4000, 1, []), (4001, 1, []), (4002, 0, [])]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == plain_negatives(rows) and len(got) > 100


def test_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = [(i * 10, int(rng.integers(3)), [float(x) for x in np.float32(np.abs(rng.normal(size=4)))]) for i in range(200)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain_negatives(rows)


def test_negatives_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, 2, [0.9, 0.9]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]),
            (None, 2, [1.0, 1.0]), (2, 2, [0.9, 0.9]), (200, 9, [1.0, 1.0]), (100, 2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("mine")).withColumn("id", F.lit(1)).withColumn("v", F.lit(None))
    got = mined(df)
    assert got == plain_negatives([(0, 1, [1.0, 1.0]), (1, 1, [1.0, np.float32(0.9)]), (2, 2, [np.float32(0.9)] * 2), (200, 9, [1.0, 1.0]), (100, 2, [0.0, 0.0])])
    assert got
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], SCHEMA)) == []


# 12 ----------------------------------------------------------------------------------------------------------------


def plain_runs(words, shortest=12):
    n, seen = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(shortest, 2 * p):
                seen.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in seen.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_a_plain_version(letters):
    rng = random.Random(letters)
    for _ in range(300):
        n = rng.randint(0, 70)
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n) if a + (i - a) % p < n]
        for shortest in (2, 3, 5, 12):
            assert runs.runs_of(w, shortest) == plain_runs(w, shortest)


def test_long_repetitive_texts():
    fib, before = "ab", "a"
    while len(fib) < 3000:
        fib, before = fib + before, fib
    assert runs.runs_of(list(fib[:3000]), 12) == plain_runs(fib[:3000])
    assert runs.runs_of(["x"] * 50_000, 12) == [(0, 50_000, 1)]
    block = [str(i) for i in range(4000)]
    assert runs.runs_of(["u", *block * 3, *block[:7], "v"], 12) == [(1, 12_007, 4000)]


def test_only_repeated_stretches_reach_the_automaton():
    w = np.r_[np.arange(500), np.tile(np.arange(600, 607), 4), np.arange(1000, 1500), np.arange(20, 60)]
    found = runs.stretches(w, 12)
    assert found == [(500, 528)]
    assert runs.stretches(np.arange(1000), 12) == [] and runs.stretches(np.arange(3), 12) == []


def test_kept_words():
    w = list("abababxyzxyzxyz")
    assert runs.kept_words(w, [(0, 6, 2), (6, 9, 3)]) == list("abxyz")
    assert runs.kept_words(w, [(0, 6, 2), (1, 5, 2), (6, 9, 3)]) == list("abxyz")
    assert runs.kept_words(w, []) == w


TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c " * 5), (5, "a b c " * 5), (6, "x " * 5000), (None, "q r " * 9), (7, "é é é é " * 6), (8, "w\x1cv\x85 " * 12),
    (9, " ".join(map(str, range(3000))) + " " + "t u v\tw\x0b" * 40),
]


def test_periodic_runs_of_rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("mine"))
    got = runs.periodic_runs(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = []
    for i, t in TEXTS:
        w = WORD.findall(t or "")
        r = plain_runs(w) if len(set(w)) > 1 else ([(0, len(w), 1)] if len(w) > 11 else [])
        gone = {k for s, n, p in r for k in range(s + p, s + n)}
        want.append((i, len(w), r, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, shortest=1)


def plain_planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


# 13 ----------------------------------------------------------------------------------------------------------------


def plain_kept(rows, window):
    first, out = {}, []
    place = lambda i: (i is None, i or 0)
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in sorted(split, key=lambda r: place(r[0])):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if place(first[tuple(w[k:k + window])]) < place(i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=lambda r: (place(r[0]), r[1:]))


def kept(df, **more):
    rows = substrings.drop_repeated(df, **more).collect()
    for r in rows:
        assert sum(x["length"] for x in r["removed"]) == r["n_removed"]
        assert all(a["start"] + a["length"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("window", [1, 2, 5, 7, 8, 13, 14, 30, 50])
def test_repeated_passages_equal_a_plain_version(spark, window):
    rng = random.Random(window)
    pool = [[str(rng.randrange(400)) for _ in range(rng.randint(5, 120))] for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [rng.choice(pool) if rng.random() < 0.4 else [str(rng.randrange(3000)) for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(0, 4))]
        rows.append((i * 3 % 160, " ".join(w for p in parts for w in p)))
    rows += [(500, "same " * 200), (501, "same " * 90), (502, "same " * 12)] + [(600 + i, " ".join(pool[0] + ["tail", str(i)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert kept(df, window=window) == plain_kept(rows, window)


def test_slices_of_a_batch_settle_alike(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.randrange(6)) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string"), window=4, first=2) == plain_kept(rows, 4)
    monkeypatch.setattr(substrings, "SLICE", 200)
    texts = pa.array([t for _, t in rows])
    sizes = [b.num_rows for b in substrings.slices(iter([pa.RecordBatch.from_arrays([pa.array(range(120)), texts], names=["id", "text"])]), 1)]
    assert sum(sizes) == 120 and len(sizes) > 20


def test_repeated_passages_edge_cases(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "short text"), (5, p), (6, f" x {p} y\x1cz"), (6, p), (7, p.replace(" ", "\n\t ")), (None, p), (None, f"{p} end"), (8, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11"),
        (-3, "p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16 p17"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("known", F.lit("mine")).withColumn("own", F.lit(1))
    assert kept(df) == plain_kept(rows, 13)
    assert substrings.drop_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_double_up_to_the_window():
    assert substrings.levels(13) == [7, 13] and substrings.levels(50) == [7, 13, 25, 50] and substrings.levels(5) == [5]
    for w in range(1, 300):
        chain = substrings.levels(w)
        assert chain[-1] == w and all(a < b <= 2 * a for a, b in zip(chain, chain[1:], strict=False))


def test_a_shared_passage_costs_a_row_a_slice():
    ids, keys = np.repeat(np.arange(1000), 3), np.tile(np.array([5, 6, 7], np.uint64), 1000)
    at, kind = substrings.settled(ids, [keys], False)
    assert (kind == 1).sum() == 3 and (kind == 0).sum() == 0 and (kind == 2).sum() == 3000
    at, kind = substrings.settled(ids, [keys], True)
    assert sorted(ids[at[kind == 0]]) == [0, 0, 0] and (kind == 2).sum() == 2997


# the registered queries --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    passage = " ".join(str(rng.randrange(50)) for _ in range(40))
    rows = [(i, None if i % 17 == 0 else " ".join([*(str(rng.randrange(30)) for _ in range(rng.randint(0, 120))), *([passage] if i % 4 == 0 else [])])) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    npr = np.random.default_rng(9)
    vecs = [(i, int(npr.integers(10)), [float(x) for x in np.float32(npr.normal(size=6) + 1)]) for i in range(400)]
    spark.createDataFrame(vecs, SCHEMA).write.parquet(f"{d}/embeddings.parquet")
    return d, rows, vecs


def test_op11_query(spark, small):
    d, _, vecs = small
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in vecs]
    got = queries.op11_kronecker_negatives(spark, d)
    assert sorted(map(tuple, got.select(*ORDER).collect())) == plain_negatives(rows)


def test_op12_query(spark, small):
    d, rows, _ = small
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, d).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 8
    for i, t in rows:
        w = plain_planted(i, t)
        found = plain_runs(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        milli = 1000 * top[1] // top[2] if found else None
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        assert tuple(got[i]) == (i, len(found), *top, milli, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op13_query(spark, small):
    d, rows, _ = small
    got = sorted(map(tuple, queries.op13_level_doubling(spark, d).collect()))
    assert got == sorted((i, n, gone, sha(text)) for i, n, gone, text in plain_kept(rows, 13))
    assert sum(r[2] for r in got) > 1000
