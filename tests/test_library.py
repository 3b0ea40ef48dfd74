"""Library and vector operators against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vodmill.operators import library as L
from vodmill.operators import vectors as V
from vodmill.plans.catalog import QUERIES, SQL
from vodmill.plans.library_queries import caption_files


@pytest.mark.parametrize(("seconds", "interval", "frames"), [(30, 5, 6), (60, 5, 12), (61, 10, 7), (600, 10, 60), (601, 30, 21), (3600, 30, 120), (3601, 60, 61), (10800, 60, 180), (28800, 120, 240)])
def test_sampling_bands(spark, seconds, interval, frames):
    df = spark.createDataFrame([("m", "video", float(seconds))], "media_id string, media_kind string, duration_seconds double")
    r = L.sampling_plan(df).first()
    assert (r["interval_seconds"], len(r["timestamps_ms"])) == (interval, frames)


def test_sampling_odd_media(spark):
    df = spark.createDataFrame([("a", "video", 12.2), ("b", "image", None), ("c", "audio", 9.0), ("d", "video", None)], "media_id string, media_kind string, duration_seconds double")
    assert {r["media_id"]: r["timestamps_ms"] for r in L.sampling_plan(df, 5).collect()} == {"a": [0, 5000, 10000], "b": [0], "c": [], "d": [0]}


def test_ingest(spark):
    files = spark.createDataFrame([("a", 1, 1, "h1"), ("b", 1, 1, "h2"), ("c", 1, 1, "h2"), ("d", 2, 2, "h9"), ("e", 1, 1, "h0")], "source_path string, size_bytes long, source_modified_ns long, checksum_sha256 string")
    media = spark.createDataFrame([("m1", "a", 1, 1, "h1"), ("m2", "d", 1, 1, "h8"), ("m3", "q", 1, 1, "h0")], "media_id string, source_path string, size_bytes long, source_modified_ns long, checksum_sha256 string")
    assert {r["source_path"]: r["outcome"] for r in L.ingest(files, media).collect()} == {"a": "skipped", "b": "created", "c": "skipped", "d": "updated", "e": "skipped"}


@pytest.mark.parametrize(("interval", "coarse", "frames"), [(5, 60000, 11), (60, 600000, 31), (5, 0, 6)])
def test_refinement(spark, interval, coarse, frames):
    df = spark.createDataFrame([("video", 3600.0, interval, coarse), ("image", None, interval, coarse)], "media_kind string, duration_seconds double, interval_seconds int, coarse_ms long")
    got = {r["media_kind"]: r["frames_ms"] for r in L.refinement_plan(df).collect()}
    assert len(got["video"]) == frames and coarse in got["video"] and got["image"] is None


def test_traces_are_idempotent(spark):
    rows = spark.createDataFrame([("m", "language", 0, 5, "x", "1", "c", "hi"), ("m", "language", 0, 5, "x", "1", "c", "hi"), ("m", "language", 5, 9, "x", "1", "c", "yo")], ", ".join(f"{c} {'long' if c.endswith('ms') else 'string'}" for c in L.IDENTITY[:4]) + ", extractor string, extractor_version string, configuration_hash string, content_text string")
    first = L.import_traces(rows, rows.limit(0))
    assert sorted(r["outcome"] for r in first.collect()) == ["created", "created", "reused"]
    again = L.import_traces(rows, first.where("outcome = 'created'").drop("outcome"))
    assert {r["outcome"] for r in again.collect()} == {"reused"}


def test_artifact_paths_stay_inside(spark):
    r = spark.range(1).select(*[L.artifact_path(F.lit(m), F.lit("n"), F.lit("1"), F.lit("c"), F.lit(5)).alias(a) for m, a in (("m", "a"), ("../m", "b"))]).first()
    assert r["a"].endswith("/000000000005.jpg") and r["b"] is None


def test_codec_and_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), ([float("inf"), 1.0],)], "v array<float>")
    got = [r["u"] for r in df.select(V.l2_normalize(F.col("v")).alias("u")).collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1:] == [None, None, None]
    b = df.limit(1).select(V.encode_vector("v").alias("b"))
    assert bytes(b.first()["b"]) == np.array([3, 4], "<f4").tobytes()
    assert b.select(V.decode_vector(F.col("b"), F.lit(2)).alias("x"), V.decode_vector(F.col("b"), F.lit(3)).alias("y")).first()["y"] is None


def test_top_k_ties_partitions_and_errors(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "trace_id long, vector array<float>").repartition(4)
    got = [(r["rank"], r["trace_id"], r["score"]) for r in V.cosine_top_k(df, [(7, [1.0, 0.0])], 3).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert V.cosine_top_k(df.limit(0), [(7, [1.0, 0.0])], 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        V.cosine_top_k(df, [(7, [1.0, 0.0])], 0)
    with pytest.raises(Exception, match="dimension 3"):
        V.cosine_top_k(df, [(7, [1.0, 0.0])], 3, [3]).collect()


@pytest.mark.parametrize("block", [20, 4096])
def test_cosine_top_k_of_every_hundredth_row(spark, monkeypatch, block):
    x = np.random.default_rng(3).normal(size=(6000, 8)).astype("f4")
    x[::7] = x[0]  # a common vector: ties go to the smaller key
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "trace_id long, vector array<float>").repartition(3)
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "ROW_BYTES", 50_000)
    got = V.cosine_top_k(df, df.where("trace_id % 100 = 0").withColumnRenamed("trace_id", "query_id"), 5, [8, 4]).toPandas()
    for d in (8, 4):
        u = x[:, :d] / np.linalg.norm(x[:, :d].astype("f8"), axis=1, keepdims=True)
        for q in range(0, 6000, 100):
            s = np.round(np.clip(u @ u[q], -1, 1), 8)
            mine = got[(got.dimension == d) & (got.query_id == q)].sort_values("rank")
            assert list(mine.trace_id) == list(np.lexsort((np.arange(6000), -s))[:5])
    assert len(got) == 2 * 60 * 5


def test_cosine_top_k_takes_more_queries_than_a_block(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "trace_id long, vector array<float>")
    queries = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(V.QUERY_BLOCK + 1)]
    got = V.cosine_top_k(df, queries, 1).toPandas()
    assert len(got) == len(queries) and (got.trace_id == 2 - got.query_id % 2).all()


def test_evaluation_spec():
    spec = {"dimensions": [8, 16], "topK": 3, "queries": [{"id": "a", "kind": "positive", "text": "x"}, {"id": "b", "kind": "control", "text": "y"}]}
    assert V.check_spec(spec, 64) == {"dimensions": [16, 8], "top_k": 3, "positive": 1, "control": 1}
    for bad in ({"dimensions": [128]}, {"dimensions": [8, 8]}, {"topK": 0}, {"queries": []}, {"queries": [{"id": "a", "kind": "odd", "text": "x"}]}, {"queries": spec["queries"] * 2}):
        with pytest.raises(ValueError):
            V.check_spec(spec | bad, 64)


def test_model_output_is_checked(spark):
    df = spark.createDataFrame([(1, "a")], "trace_id long, content string")
    with pytest.raises(Exception, match="not finite or is zero"):
        V.embed_missing(df, lambda: lambda xs: np.zeros((len(xs), 2)), "m", 2, "content").collect()


def test_registry():
    assert len(QUERIES) > 80 and set(SQL) <= set(QUERIES)


def test_reports_and_captions_do_not_grow_with_the_table(spark, tmp_path):
    import glob
    import json

    n, sf = 300_000, str(tmp_path)
    spark.range(n).select(F.col("id").alias("l_orderkey"), F.lit(5).cast("long").alias("l_partkey"), (F.col("id") % 7).cast("double").alias("l_quantity")).write.parquet(f"{sf}/lineitem.parquet")
    old = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/report-*"))
    got = {r["report"]: (r["n"], r["views"]) for r in QUERIES["io2_read_report_json"](spark, sf).collect()}
    assert got == {r: (n // 50, sum(i % 7 for i in range(r, n, 50))) for r in range(50)}
    (path,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/report-*")) - old
    reports = [json.load(open(f)) for f in glob.glob(f"{path}/*/part-*")]
    assert sum(len(x["rows"]) for x in reports) == n and max(len(x["rows"]) for x in reports) <= 4096

    turns = [(1, i, f"t{i}" if i // 1024 != 2 else " ") for i in range(5000)] + [(2, 0, "a  b")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(4).write.parquet(f"{sf}/conversations.parquet")
    assert max(len(json.loads(r["json"])["events"]) for r in caption_files(spark, sf).collect()) <= 1024
    texts = {r["stream_id"]: r["text"] for r in QUERIES["io4_caption_plain_text"](spark, sf).collect()}
    stamp = lambda s: f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60:02d}:{s % 60:02d}"
    assert texts == {1: "\n".join(f"{stamp(4 * i)} t{i}" for _, i, t in turns[:-1] if t != " "), 2: "00:00 a  b"}
    assert QUERIES["io3_caption_json3"](spark, sf).count() == 5001 - 1024
