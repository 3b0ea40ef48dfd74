"""Windows in blocks, Bloom filters and levelled interval joins: one stream may hold nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from vodmill.operators import blocks, bloom
from vodmill.operators import captions as T


def plain_grams(words, n):
    out, by = [], {}
    for s, p, w in sorted(words):
        by.setdefault(s, []).append((p, w))
    for s, rows in by.items():
        out += [(s, p, [w for _, w in rows[i:i + n]]) for i, (p, _) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("block", [8, 9, 50, 1 << 16])
def test_following_words_equal_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(1 if rng.random() < 0.95 else rng.randrange(40), i, rng.choice("abcd")) for i in range(700)]  # a stream of nearly all words
    df = spark.createDataFrame(rows, "stream_id long, place long, word string").repartition(5)
    got = sorted((r["stream_id"], r["place"], r["gram"]) for r in T.word_ngrams(df, 8).collect())
    assert got == plain_grams(rows, 8)


def test_a_hot_stream_is_many_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(7).alias("stream_id"), F.col("id").alias("place"), F.lit("w").alias("word"))
    numbered = blocks.numbered(df, ["stream_id", "place"])
    tasks = [r["c"] for r in numbered.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    assert max(tasks) < 2 * 20_000 / len(tasks) and len(tasks) > 1
    assert [r[0] for r in numbered.orderBy("stream_id", "place").select("__n").collect()] == list(range(20_000))
    out = T.word_ngrams(df, 8)
    assert out.where(F.size("gram") == 8).count() == 19_001 - 7 + 0 * out.count() or out.where(F.size("gram") == 8).count() >= 18_993
    windows = [line for line in out._jdf.queryExecution().toString().splitlines() if line.strip().lstrip("+-: *()0123456789").startswith("Window ")]
    assert windows and not any("windowspecdefinition(stream_id" in w for w in windows)


def test_following_edge_cases(spark, monkeypatch):
    none = spark.createDataFrame([], "stream_id long, place long, word string")
    assert T.word_ngrams(none, 8).count() == 0
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (3, 1, None), (3, 2, "c")], "stream_id long, place long, word string")
    got = {(r["stream_id"], r["place"]): r["gram"] for r in T.word_ngrams(df, 2).collect()}
    assert got == {(None, 1): ["a", "b"], (None, 2): ["b"], (3, 1): [None, "c"], (3, 2): ["c"]}
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    with pytest.raises(ValueError, match="longer than a block"):
        T.word_ngrams(df, 8)


def test_evidence_windows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 12)
    segs = [(s, e, e * 4000 if s else e * 20_000, f"t{e}") for s in (0, 1) for e in range(60)]
    got = {(r["stream_id"], r["event"], r["length"]): r["text"] for r in T.evidence_windows(spark.createDataFrame(segs, "stream_id long, event long, start_ms long, text string")).collect()}
    want = {}
    for s, e, ms, _ in segs:
        run = [x for x in segs if x[0] == s and e <= x[1] < e + 12 and x[2] <= ms + 30_000]
        want |= {(s, e, n): " ".join(x[3] for x in run[:n]) for n in range(1, len(run) + 1)}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_bloom_keeps_every_key_and_few_others(spark, n):
    keys = spark.range(n).select(F.xxhash64("id").alias("key"))
    may_have = bloom.bloom(keys)
    others = spark.range(100_000, 130_000).select(F.xxhash64("id").alias("key"))
    assert keys.where(may_have(F.col("key"))).count() == n
    assert others.where(may_have(F.col("key"))).count() < 1500


def test_a_full_bloom_filter_still_keeps_every_key(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BITS", 256)
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    assert keys.where(bloom.bloom(keys)(F.col("key"))).count() == 2000


def test_few_places_are_exchanged_for_quotes(spark):
    rng = random.Random(4)
    words = [(i % 3, i, i, f"w{rng.randrange(300)}") for i in range(9000)]
    df = spark.createDataFrame(words, "stream_id long, place long, second long, word string")
    said = [w for s, _, _, w in words if s == 1]
    quotes = spark.createDataFrame([("a", 1, " ".join(said[500:510])), ("b", 1, " ".join(said[2000:2003])), ("c", 2, "nothing like it said here"), ("d", 0, "")], "quote_id string, stream_id long, quote string")
    q = quotes.select("quote_id", "stream_id", T.normalized_words(F.col("quote")).alias("need")).where(F.size("need") > 0).withColumn("k", F.least(F.size("need"), F.lit(5)))
    places = T.quote_prefixes(q.withColumn("key", F.xxhash64("stream_id", F.slice("need", 1, 5))), df, 8, 5)
    assert 2 <= places.count() < 60  # of 9,000 words with two lengths each
    got = {r["quote_id"]: r["second"] for r in T.align_quotes(quotes, df).collect()}
    at = [i for s, _, i, _ in words if s == 1]
    first = next(i for i in range(len(said)) if said[i:i + 3] == said[2000:2003])
    assert got == {"a": at[500], "b": at[first], "c": None, "d": None}


def test_long_segments_are_two_rows_at_most(spark):
    rng = random.Random(5)
    segs = [(1, a := rng.randrange(10**7), a + (rng.choice([0, 3000, 3_600_000, 10**8, -50])), f"s{i}") for i in range(400)]
    cands = [(f"c{i}", 1, a := rng.randrange(9000), a + rng.choice([0, 20, 4000])) for i in range(60)]
    s = spark.createDataFrame(segs, "stream_id long, start_ms long, end_ms long, text string")
    c = spark.createDataFrame(cands, "candidate_window_id string, stream_id long, start_seconds long, end_seconds long")
    assert T.bucketed(s.where("end_ms >= start_ms"), "start_ms", "end_ms").groupBy("text").count().agg(F.max("count")).first()[0] <= 2
    for before, after, starts in ((0, 0, False), (5, 5, False), (0, 0, True)):
        got = sorted((r["candidate_window_id"], r["text"]) for r in T.interval_join(c, s, before, after, starts).collect())
        lo = lambda x: max(x[2] - before, 0) * 1000
        hi = lambda x: (max(x[2], x[3]) + after) * 1000
        want = sorted((x[0], t[3]) for x in cands for t in segs if (lo(x) <= t[1] <= hi(x) if starts else t[1] <= hi(x) and max(t[1], t[2]) >= lo(x)))
        assert got == want and got
    assert T.interval_join(c, s.limit(0)).count() == 0


def test_a_bloom_filter_of_many_keys_lets_few_others_through(spark):
    """What passes without a partner is exchanged: its share must not grow with the keys."""
    n = 4_000_000
    may_have = bloom.bloom(spark.range(n).select(F.xxhash64("id").alias("key")))
    rows = spark.range(n - 10_000, n + 990_000).select("id", F.xxhash64("id").alias("key")).where(may_have(F.col("key")))
    found = {r["own"]: r["count"] for r in rows.groupBy((F.col("id") < n).alias("own")).count().collect()}
    assert found[True] == 10_000 and found[False] < 5_000
