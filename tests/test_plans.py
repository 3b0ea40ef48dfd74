"""Registered queries and their SQL on small tables with odd rows."""

import datetime

import duckdb

from vodmill.plans.catalog import QUERIES, SQL


def test_minutes_of_zero_fall_through_in_query_and_sql(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 0, 7)
    rows = [(i, at, u, "x", v, "") for i, (u, v) in enumerate([(2, 0.0), (2, 1.5), (3, 0.0), (3, 2.5), (5, 0.0), (5, 4.0), (6, 0.0), (9, 0.0)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("s5_s13_classify_fields", "s6_watch_minutes"):
        got = {r["event_id"]: r["minutes"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        c = duckdb.connect()
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = dict(c.execute(f"SELECT event_id, minutes FROM ({SQL[name]})").fetchall())
        assert got == want == {0: 2.0, 1: 1.5, 2: 3.0, 3: 150.0, 4: 5.0, 5: 5.0, 6: 6.0, 7: 9.0}


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_response_is_cut_and_its_scores_are_parsed_once(spark):
    from vodmill.operators import responses as R

    text = "1. A (00:10 - 01:10)\nRank: 1\nComponent Scores: Hook: 88, hook: 101, Audio: 7\nUsefulness Score: 61\n\nno header (x)\n2. B (1:00:10 - 1:01:10)\nRank: 2\n"
    out = R.parse_native_response(spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "id int, text string")).select("id", "position", "title", "start_seconds", "scores", "valid")
    plan = planned(out)
    assert "Filter (size(filter(" not in plan and plan.count(r"\r?\n") == 1  # not anew for every line
    assert plan.count("array_position") == 12  # eleven names, and the first of equal fields
    rows = [(r["id"], r["position"], r["title"], r["start_seconds"], r["scores"]["hook_strength"], r["scores"]["audio_clarity"], r["scores"]["editing_potential"], r["valid"]) for r in out.orderBy("position").collect()]
    assert rows == [(1, 0, "A", 10, 84, 7, 61, True), (1, 1, "B", 3610, 75, 75, 80, True)]


def test_times_tags_and_scores_without_a_formatter(spark):
    from pyspark.sql import functions as F

    from vodmill.functions import candidates as C

    s = spark.createDataFrame([(x,) for x in (0, 59, 3599, 3600, 360_000, 400_000, -1, -61)], "s long")
    old = F.format_string("%02d:%02d:%02d", F.floor(F.col("s") / 3600), F.floor(F.col("s") / 60) % 60, F.col("s") % 60)
    df = s.select(C.seconds_to_timestamp(F.col("s")).alias("a"), old.alias("b"), C.time_label(F.col("s"), F.lit("video")).alias("label"))
    assert "format_string" not in planned(df.select("a", "label")) and all(r["a"] == r["b"] for r in df.collect())
    tags = spark.createDataFrame([([" _A  b-_c- ", "a-b-c", "--", "x"],)], "t array<string>").select(C.normalize_tags(F.col("t")).alias("t"))
    assert tags.first()["t"] == ["a-b-c", "x"]
    for kind in ("int", "long", "double", "decimal(9,3)"):
        got = spark.createDataFrame([(1,)], "i int").select(F.struct(F.lit(33).cast(kind).alias("p"), F.lit(None).cast(kind).alias("q"), F.lit(7).cast(kind).alias("r")).alias("s")).select(C.weighted_score(F.col("s"), {"p": 10, "q": 3, "r": 2}).alias("w"))
        assert got.first()["w"] == 22.93 and (kind != "int" or "decimal(18,6)" not in planned(got))


def test_the_text_of_evidence_is_made_once(spark):
    from pyspark.sql import functions as F

    from vodmill.functions import candidates as C

    made = F.concat(F.lit("said "), C.seconds_to_timestamp(F.col("id")), F.when(F.col("id") == 3, " marked").otherwise(""))
    df = spark.range(2, 5).select(C.parse_evidence(made, F.lit(3), F.lit(9)).alias("e"))
    assert planned(df).count(" marked") == 1
    assert [[(x["timestamp"], x["seconds"], x["text"]) for x in r["e"]] for r in df.collect()] == [[("00:00:03", 3, "said 00:00:02")], [("00:00:03", 3, "said 00:00:03 marked")], [("00:00:04", 4, "said 00:00:04")]]


def test_an_export_without_runs_joins_streams_alone(spark):
    from vodmill.operators import candidates as K

    c = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "candidate_window_id string, stream_id long, analysis_run_id long")
    s = spark.createDataFrame([(1, "t", "p", "v")], "stream_id long, title string, published_at string, source_video_id string")
    out = K.enrich(c, s)
    assert planned(out).count("Join ") == 1 and [tuple(r) for r in out.select("candidate_window_id", "stream_title").collect()] == [("a", "t")]


def test_reviews_are_parsed_once(spark):
    """T3 needs the reviews at several places; what it returns reads them and makes none anew."""
    from vodmill.plans.catalog import QUERIES

    out = QUERIES["t3_structured_candidates"](spark, "/root/testdata/sf0.001")
    assert "Clip one (" not in out._jdf.queryExecution().toString()
    assert out.count() > 0


def test_media_are_listed_once_by_few_tasks(spark, tmp_path):
    import hashlib

    from vodmill.sources import files

    for i in range(1, 301):
        (tmp_path / f"{i}.mp4").write_bytes(b"x" * i)
    media = files.scan_media(spark, str(tmp_path))
    assert media.rdd.getNumPartitions() == 1
    out = files.with_checksums(media)
    assert "binaryFile" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["source_path"]: (r["size_bytes"], r["checksum_sha256"], r["error"]) for r in out.collect()}
    assert got == {f"{i}.mp4": (i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(1, 301)}


def test_media_of_odd_documents_equal_the_sql(spark, tmp_path):
    """Empty texts, none, repeated ids, ids below zero and none: a row each, as in SQL."""
    rows = [(0, "a"), (1, ""), (3, None), (3, "x y"), (3, "x y"), (4, "ü"), (50, ""), (50, None), (-1, "m"), (-50, "n"), (5, "t"), (None, "no id"), (6, "b" * 5000), (9, None), (11, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["io5_scan_media"](spark, str(tmp_path)).select("name", "media_kind", "size_bytes", "checksum", "failed").collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(SQL["io5_scan_media"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 14


def test_names_with_blanks_and_signs_are_read(spark, tmp_path):
    import hashlib

    from vodmill.sources import files

    names = {"a b.mp4", "c%20d.png", "e#f.mov", "g?h.mkv", "ü [1].jpg", "p:q.gif", ".hidden.mp4", "_x.mp4", "empty.mp4"}
    for n in names:
        (tmp_path / "in" / "sub dir").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "sub dir" / n).write_text("" if n == "empty.mp4" else n)
    for root in (f"{tmp_path}/in", f"file:{tmp_path}/in/", f"file://{tmp_path}/in"):
        got = {r["source_path"]: (r["size_bytes"], r["checksum_sha256"], r["error"], r["source_modified_ns"]) for r in files.with_checksums(files.scan_media(spark, root)).collect()}
        texts = {n: ("" if n == "empty.mp4" else n).encode() for n in names}
        assert got == {f"sub dir/{n}": (len(t), hashlib.sha256(t).hexdigest(), None, (tmp_path / "in" / "sub dir" / n).stat().st_mtime_ns) for n, t in texts.items()}
    assert files.scan_media(spark, str(tmp_path / "nowhere")).count() == 0


def test_what_a_task_lacks_is_no_outcome_of_a_file(monkeypatch, tmp_path):
    """Without memory or handles the task fails and is tried again; the file is not one that can't be read."""
    import errno

    import pytest

    from vodmill.sources import files

    def lacking(path):
        raise e

    assert files.checksum(f"{tmp_path}/gone", 9)[1].startswith("FileNotFoundError")
    monkeypatch.setattr(files, "located", lacking)
    for e in (OSError(errno.EMFILE, "too many open files"), MemoryError()):
        with pytest.raises(type(e)):
            files.checksum("x", 9)
    e = PermissionError(errno.EACCES, "no")
    assert files.checksum("x", 9) == (None, "PermissionError: [Errno 13] no")


def test_a_file_is_replaced_whole(spark, tmp_path):
    """A reader of the old file keeps it: it is not emptied and written anew."""
    from vodmill.plans.library_queries import written

    place = tmp_path / "in"
    for text in ("one", "another"):
        written(spark.createDataFrame([("a/b", text)], "name string, content string"), str(place), ".mp4")
        if text == "one":
            (tmp_path / "kept").hardlink_to(place / "a" / "b.mp4")
    assert (tmp_path / "kept").read_text() == "one" and (place / "a" / "b.mp4").read_text() == "another"
    assert [p.name for p in place.rglob("*") if p.is_file()] == ["b.mp4"]


def test_the_driver_holds_no_list_of_media_and_bounded_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from vodmill.sources import dealing, files

    for i in range(40):
        (tmp_path / f"{i % 7}/{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{i % 7}/{i % 3}/{i}.mp4").write_bytes(b"x")
    monkeypatch.setattr(files, "LISTED_ROWS", 2)
    media = files.scan_media(spark, str(tmp_path))
    assert "binaryFile" not in media._jdf.queryExecution().toString()
    assert {r["source_path"] for r in media.collect()} == {f"{i % 7}/{i % 3}/{i}.mp4" for i in range(40)}
    monkeypatch.setattr(dealing, "MOST_TASKS", 8)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("path"), F.lit(0).cast("long").alias("length"))
    out = dealing.dealt_by_size(rows, task_bytes=1 << 22)
    assert out.rdd.getNumPartitions() <= 9 and sorted(int(r["path"]) for r in out.collect()) == list(range(1000))


def test_places_of_captions_stream_through_the_filter(spark):
    """A Python function in a filter keeps every row in a queue, which goes to disk where memory is short."""
    from vodmill.operators import bloom

    out = QUERIES["t3_structured_candidates"](spark, "/root/testdata/sf0.001")
    assert "EvalPython" not in planned(out)
    rows = spark.createDataFrame([(1, 10, None), (2, 11, 10), (3, None, None), (4, 12, 13)], "id int, a long, b long")
    got = bloom.passing(rows, ["a", "b"], spark.createDataFrame([(10,)], "key long")).collect()
    assert sorted((r["id"], r["a"], r["b"]) for r in got) == [(1, 10, None), (2, None, 10)]
