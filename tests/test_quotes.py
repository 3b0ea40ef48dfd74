"""Quotes against captions whose segments stay whole: grams over edges, equal places, what is exchanged."""

import random

import pytest
from pyspark.sql import functions as F

from vodmill.operators import blocks
from vodmill.operators import captions as T


def caption_rows(seed, n=400):
    """A stream of nearly all segments, many of one word, some of none."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "It's", "c-d", "Ä", "--"])
    return [(1 if rng.random() < 0.9 else rng.randrange(5), i, i * 4000, " ".join(word() for _ in range(rng.choice([0, 1, 1, 2, 7, 8, 9, 30])))) for i in range(n)]


@pytest.mark.parametrize(("n", "block"), [(8, 8), (8, 1 << 16), (2, 50), (1, 50)])
def test_grams_of_whole_segments_equal_those_of_words(spark, monkeypatch, n, block):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    segs = spark.createDataFrame(caption_rows(n), "stream_id long, event long, start_ms long, text string").repartition(3)
    rows = lambda df: sorted((r["stream_id"], tuple(r["place"]["o"]), r["place"]["k"], r["second"], r["gram"]) for r in df.collect())
    assert rows(T.caption_grams(segs, n, order=("event",))) == rows(T.word_ngrams(T.caption_words(segs, order=("event",)), n))


def test_quotes_over_segment_edges(spark):
    segs = spark.createDataFrame(caption_rows(3), "stream_id long, event long, start_ms long, text string")
    said = T.caption_words(segs, order=("event",))
    words = [r["word"] for r in said.where("stream_id = 1").orderBy("place").collect()]
    quotes = spark.createDataFrame([(i, 1, " ".join(words[i * 9:i * 9 + 1 + i % 12] + ["zqa"] * (i % 3))) for i in range(120)], "quote_id long, stream_id long, quote string")
    got = {r["quote_id"]: r["second"] for r in T.align_quotes(quotes, T.caption_grams(segs, order=("event",))).collect()}
    assert got == {r["quote_id"]: r["second"] for r in T.align_quotes(quotes, said).collect()} and sum(x is not None for x in got.values()) > 60


def test_equal_places_and_equal_quotes_meet_once(spark):
    segs = spark.range(600).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("event"), (F.col("id") * 4000).alias("start_ms"), F.lit("so it goes on and on every single day").alias("text"))
    quotes = spark.range(500).select(F.col("id").alias("quote_id"), F.lit(1).cast("long").alias("stream_id"), F.lit("it goes on and on every").alias("quote"))
    out = T.align_quotes(quotes, T.caption_grams(segs, order=("event",)))
    assert out.select("second").distinct().collect() == [(0,)] and out.count() == 500
    # 600 equal places in 4 input tasks: no join may pair each with every quote
    out.collect()
    metrics, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "Join" in node.nodeName():
            found = node.metrics().get("numOutputRows")
            metrics += [found.get().value()] if found.isDefined() else []
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert metrics and max(metrics) <= 600


def test_the_text_of_captions_is_not_exchanged(spark, monkeypatch):
    """Of a segment only its edge words are put in order."""
    seen = []
    plain = T.following
    monkeypatch.setattr(T, "following", lambda df, *a: seen.append(df) or plain(df, *a))
    long = " ".join(f"w{i}" for i in range(4000))
    segs = spark.range(20).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("event"), (F.col("id") * 4000).alias("start_ms"), F.lit(long).alias("text"))
    assert T.caption_grams(segs, order=("event",)).count() == 80_000
    assert seen[0].count() == 20 and max(sum(len(str(v)) for v in r) for r in seen[0].collect()) < 200
