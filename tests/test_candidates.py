"""Candidate, caption and response operators against known values."""

import pytest
from pyspark.sql import functions as F

from vodmill.functions import candidates as C
from vodmill.operators import captions as T
from vodmill.operators import library
from vodmill.operators import candidates as K
from vodmill.operators import responses as R
from vodmill.plans import bindings as B
from vodmill.sources import files

NATIVE = """Sure, here are two:
1. Burn-through on walnut (40:35 - 47:05)
Rank: 1
Duration: 6:30
Primary Pillar: Mistakes & problem solving
Summary: He burns
  through the board.
Tags: Mistake Recovery, #wood
Transcript Evidence: (41:00) "that went too far"
Visual Evidence: smoke at 99:00
Completeness Check: whole story
Window Type: source window
Chatter Risk: low
Exact Caption Quote: that went too far
Possible Hooks: "I ruined it" / "Watch this"
Component Scores: Hook: 90, Clarity: 150, Confidence: 84
Usefulness Score: 88

2. Fire safety (1:00:00 - 1:01:30)
Rank: 2
Primary Pillar: Humor & personality
Chatter Risk: high
"""


def test_native_response(spark):
    df = spark.createDataFrame([(1, NATIVE), (2, NATIVE.replace("47:05", "39:00")), (3, "no candidates here")], "id int, text string")
    rows = {(r["id"], r["position"]): r for r in R.parse_native_response(df).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    a, b = rows[1, 0], rows[1, 1]
    assert (a["title"], a["start_seconds"], a["end_seconds"], a["start_timestamp"]) == ("Burn-through on walnut", 2435, 2825, "00:40:35")
    assert a["primary_pillar"] == "mistakes_problem_solving" and a["tags"] == ["mistake-recovery", "wood"] and a["possible_hooks"] == ["I ruined it", "Watch this"]
    assert a["concise_summary"] == "He burns through the board." and [e["seconds"] for e in a["transcript_evidence"]] == [2460] and [e["seconds"] for e in a["visual_evidence"]] == [2435]
    assert (a["scores"]["hook_strength"], a["scores"]["standalone_clarity"], a["scores"]["confidence"], a["scores"]["editing_potential"]) == (90, 100, 84, 88)
    assert a["risks"] == ["needs_manual_verification"]
    assert b["primary_pillar"] == "personal_journey_recovery" and b["window_type"] == "short_ready" and b["chatter_risk"] == "high"
    assert b["scores"]["hook_strength"] == 75 and b["scores"]["standalone_clarity"] == 72 and b["scores"]["editing_potential"] == 72 and b["scores"]["brand_fit"] == 76
    assert b["risks"] == ["short_ready_not_source_window", "high_chatter_risk", "missing_exact_caption_quote", "needs_manual_verification"]
    assert a["valid"] and b["valid"] and not rows[2, 0]["valid"] and not rows[2, 1]["valid"]


def test_structured_review(spark):
    text = "1. Clip (10:00 - 10:40)\nRank: 1\nScore: 86/100\nComplete Thought: No\nVisual Only: yes\nChatter Risk: high\n\nOther (11:00 - 12:00)\nSummary: no rank\n"
    rows = R.parse_structured_final(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert len(rows) == 1 and rows[0]["timestamp_range"] == "10:00 - 10:40"
    assert rows[0]["local_flags"] == ["incomplete_thought", "visual_only", "high_chatter"] and rows[0]["local_recommendation"] == "keep_as_visual_short_only"
    sec = spark.createDataFrame([(1, 590)], "id int, second long")
    r = R.structured_candidates(R.parse_structured_final(spark.createDataFrame([(1, text + "")], "id int, text string")).withColumn("exact_caption_quote", F.lit("so it is")), sec, "id").first()
    assert (r["start_seconds"], r["duration_seconds"], r["review_status"], r["scores"]["confidence"], r["primary_pillar"]) == (590, 50, "needs_verification", 82, "artistic_process")
    assert "start-adjusted-to-caption-quote" in r["risks"]


def test_structured_pass(spark, tmp_path):
    d = tmp_path / "abc_20260801_101010"
    d.mkdir()
    (d / "final.txt").write_text("x\ny")
    (d / "notes.txt").write_text("no")
    e = tmp_path / "other"
    e.mkdir()
    (e / "prompts.json").write_text('{"a": "see https://y.be/watch?v=QQ1&t=3"}')
    got = {(r["video_id"], r["artifact_type"], r["text"]) for r in R.read_structured_pass(spark, str(tmp_path)).collect()}
    assert got == {("abc", "final", "x\ny"), ("QQ1", "prompts", '{"a": "see https://y.be/watch?v=QQ1&t=3"}')}


def test_complete_passes(spark):
    files_ = spark.createDataFrame([("r/a/local_review.json", 1), ("r/b/final.txt", 9), ("r/c/local_review.json", 5), ("r/c/final.txt", 3)], "path string, modified int")
    assert [r["pass_path"] for r in R.complete_passes(files_).collect()] == ["r/c", "r/a"] and R.complete_passes(files_, 1).count() == 1


def test_tags_scores_and_times(spark):
    row = spark.createDataFrame([([" Mistake Recovery", "a__b", "", "mistake-recovery", "-x-"],)], "t array<string>").select(C.normalize_tags(F.col("t")).alias("t")).first()
    assert row["t"] == ["mistake-recovery", "a-b", "x"]
    s = spark.range(1).select(F.struct(*[F.lit(80).alias(k) for k in B.SCORES]).alias("s")).select(C.weighted_score(F.col("s"), B.SCORE_WEIGHTS).alias("a"), C.weighted_score(F.col("s"), {}).alias("b")).first()
    assert (s["a"], s["b"]) == (80.0, 0.0)
    t = spark.range(1).select(C.seconds_to_timestamp(F.lit(3661)).alias("a"), C.timestamp_to_seconds(F.lit("1:01:01")).alias("b"), C.timestamp_to_seconds(F.lit("x")).alias("c"), C.time_label(F.lit(61), F.lit("video")).alias("d"), C.time_label(F.lit(0), F.lit("image")).alias("e")).first()
    assert tuple(t) == ("01:01:01", 3661, None, "1:01", "Still image")


def test_responses_and_captions(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"events": [{"tStartMs": 1000, "dDurationMs": 2200, "segs": [{"utf8": "hello "}, {"utf8": " world"}, 5]}, 7, {"tStartMs": 1, "segs": [{"utf8": " \\n"}]}, {"tStartMs": 5000, "dDurationMs": 1000, "segs": [{"utf8": "dragon  staff"}]}]}')
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in files.read_caption_json3(spark, str(f)).orderBy("event").collect()] == [(1000, 3200, "hello world"), (5000, 6000, "dragon staff")]
    bad = spark.createDataFrame([('{"events": 3}',)], "j string").select(files.caption_segments(F.col("j")).alias("s"), files.caption_plain_text(F.col("j")).alias("p")).first()
    assert bad["s"] is None
    broken = {"a.json": '{"events": 3}', "b.json": '{"events": [{"tStartMs": "soon", "segs": [{"utf8": "x"}]}]}', "c.json": "not json", "d.json": '{"events": [{"tStartMs": [1], "segs": [{"utf8": "x"}]}]}'}
    fine = {"e.json": '{"events": [{"tStartMs": "7", "segs": [{"utf8": "ok"}]}, {"tStartMs": "soon", "segs": []}]}', "f.json": "{}"}
    (tmp_path / "many").mkdir()
    for name, text in (broken | fine).items():
        (tmp_path / "many" / name).write_text(text)
    many = str(tmp_path / "many")
    assert {r["file"] for r in files.caption_failures(spark, many).collect()} == set(broken)
    assert [(r["file"], r["start_ms"], r["text"]) for r in files.read_caption_json3(spark, many, strict=False).collect()] == [("e.json", 7, "ok")]
    for name, said in (("a.json", "no array"), ("b.json", "no number"), ("c.json", "no JSON object"), ("d.json", "no number")):
        with pytest.raises(Exception, match=said):
            files.read_caption_json3(spark, f"{many}/{name}").collect()
    g = tmp_path / "r.txt"
    g.write_text('```json\n{"stream_id": "s", "candidate": {"title": "A", "start_seconds": 5, "end_seconds": 9}}\n```')
    r = files.read_candidate_responses(spark, str(g)).first()
    assert (r["candidate_rank"], r["title"], r["start_seconds"]) == (1, "A", 5)


def test_media_scan_and_exports(spark, tmp_path):
    for n in ("a/x.MP4", "a/b/y.png", "z.txt"):
        p = tmp_path / "in" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12")
    got = {(r["source_path"], r["media_kind"], r["size_bytes"]) for r in files.scan_media(spark, str(tmp_path / "in")).collect()}
    assert got == {("a/x.MP4", "video", 2), ("a/b/y.png", "image", 2)}
    import hashlib

    big = tmp_path / "in" / "a" / "x.MP4"
    big.write_bytes(b"0123456789" * 100_000)
    media = files.scan_media(spark, str(tmp_path / "in"))
    lost = media.limit(1).withColumn("path", F.lit(f"file:{tmp_path}/in/gone.mp4")).withColumn("source_path", F.lit("gone.mp4"))
    summed = files.with_checksums(media.unionByName(lost), piece=4096)
    got = {r["source_path"]: (r["checksum_sha256"], r["error"]) for r in summed.collect()}
    assert got["a/x.MP4"] == (hashlib.sha256(big.read_bytes()).hexdigest(), None) and got["a/b/y.png"][0] == hashlib.sha256(b"12").hexdigest()
    assert got["gone.mp4"][0] is None and "FileNotFound" in got["gone.mp4"][1]
    known = spark.createDataFrame([], "media_id string, source_path string, size_bytes long, source_modified_ns long, checksum_sha256 string")
    out = {r["source_path"]: r["outcome"] for r in library.ingest(summed, known).collect()}
    assert out == {"a/x.MP4": "created", "a/b/y.png": "created", "gone.mp4": "error"}
    assert library.outcome_counts(library.ingest(summed, known)).first()["error"] == 1
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    files.export_candidates(df, str(tmp_path / "csv"), "csv")
    files.export_candidates(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["tags"] == "a|b" and spark.read.json(str(tmp_path / "json")).first()["tags"] == ["a", "b"]


def test_validation_quarantines_whole_responses(spark):
    ev = [("00:00:12", 12, "x")]
    row = lambda i, resp, end, e=ev: (i, resp, "t", 10, end, 50, "00:00:10", "00:01:00", "artistic_process", e, (5,))
    df = spark.createDataFrame([row("a", 1, 60), row("b", 1, 61), row("c", 2, 60), row("d", 3, 60, [("00:02:00", 120, "x")])],
                               "candidate_window_id string, response_id int, title string, start_seconds long, end_seconds long, duration_seconds long, start_timestamp string, end_timestamp string, primary_pillar string, transcript_evidence array<struct<timestamp:string,seconds:bigint,text:string>>, scores struct<hook_strength:int>")
    got = {r["candidate_window_id"]: (r["errors"], r["quarantined"]) for r in K.validate(df, B.PILLARS, ["hook_strength"]).collect()}
    assert got["a"] == ([], True) and got["c"] == ([], False) and got["b"][1] and len(got["b"][0]) == 2
    assert got["d"] == (["evidence outside the window"], True)


CAPTIONS = [("s", 0, 10000, 14000, "We are going to drill the pilot hole"), ("s", 1, 15000, 18000, "before adding the brass insert"), ("s", 2, 90000, 94000, "completely different topic over here")]
EV = "array<struct<timestamp:string,seconds:bigint,text:string>>"


def candidate(spark, cid, start, end, excerpt, evidence=(), stream="s"):
    return spark.createDataFrame([(cid, stream, start, end, excerpt, list(evidence))], f"candidate_window_id string, stream_id string, start_seconds long, end_seconds long, transcript_excerpt string, transcript_evidence {EV}")


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(CAPTIONS, "stream_id string, event long, start_ms long, end_ms long, text string")


def test_audit(spark, segments):
    quote = "We are going to drill the pilot hole before adding the brass insert."
    rows = [candidate(spark, "ok", 10, 20, "", [("00:00:10", 10, quote)]), candidate(spark, "bad", 10, 20, "", [("00:00:10", 10, "the moon landing was filmed in a studio")]), candidate(spark, "legacy", 10, 20, quote),
            candidate(spark, "mixed", 10, 20, quote + " The moon landing was filmed in studio seven."), candidate(spark, "none", 10, 20, "The moon landing was filmed in studio seven."),
            candidate(spark, "sentinel", 10, 20, "No verified in-window transcript evidence."), candidate(spark, "short", 10, 20, "Yes."), candidate(spark, "nocaps", 10, 20, quote, stream="t")]
    df = rows[0]
    for r in rows[1:]:
        df = df.union(r)
    got = {r["candidate_window_id"]: r["status"] for r in T.audit_evidence(df, segments).collect()}
    assert got == {"ok": "pass", "bad": "fail", "legacy": "pass", "mixed": "fail", "none": "unverifiable", "sentinel": "pass", "short": "unverifiable", "nocaps": "unverifiable"}
    strict = {r["candidate_window_id"]: r["status"] for r in T.audit_evidence(df, segments, require_timed=True).collect()}
    assert strict["legacy"] == "fail" and strict["ok"] == "pass" and strict["nocaps"] == "pass" and strict["sentinel"] == "pass"


def test_grounding(spark, segments):
    df = candidate(spark, "g", 10, 20, "going to drill the pilot hole").union(candidate(spark, "out", 10, 20, "completely different topic over here")).union(candidate(spark, "kept", 10, 20, "x y z", [("00:00:10", 10, "x")]))
    got = {r["candidate_window_id"]: (r["grounded"], r["evidence"]) for r in T.ground_evidence(df, segments).collect()}
    assert got["g"][0] and [(e["seconds"], e["text"]) for e in got["g"][1]] == [(10, CAPTIONS[0][4])]
    assert not got.get("out", (False,))[0] and "kept" not in got


def test_tokens_chunks_and_support(spark):
    cut = {
        "It’s 1,200 V at 5ma ﬁne": ["it's", "1200", "volts", "at", "5", "milliamps", "fine"], "12 v, 12-v 3v's 4vx é5ma 6maé _7v a8 v": ["12", "volts", "12", "v", "3", "volts's", "4vx", "5ma", "6ma", "7v", "a8", "v"],
        "1,2,3 4,a 5,,6 \u0663 v Straße \x01v 9\x01v 1\u2003mA": ["123", "4", "a", "5", "6", "volts", "strasse", "v", "9", "v", "1", "milliamps"], "": [], "don't o'c'k 'tis": ["don't", "o'c", "k", "tis"],
        "1," * 20_000 + "5": ["1" * 20_000 + "5"], "ab" * 20_000: ["ab" * 20_000],
    }
    got = spark.createDataFrame([(t,) for t in cut] + [(None,)], "t string").select("t", T.tokens("t").alias("w")).collect()
    assert {r["t"]: r["w"] for r in got} == cut | {None: []}
    pairs = [("the red fox ran", "a red fox walked home today"), ("red fox", "a red fox"), ("no such", "words here"), ("", "a"), (None, "a"), ("a", None)]
    rows = spark.createDataFrame([tuple(None if x is None else x.split() for x in p) for p in pairs], "c array<string>, x array<string>").select("c", "x", T.support_score("c", "x").alias("s")).collect()
    assert all(r["s"] == T.score_support(r["c"] or [], r["x"] or []) for r in rows) and [r["s"] for r in rows][1:] == [1.0, 0.0, 0.0, 0.0, 0.0]
    chunks = spark.range(1).select(F.explode(C.claim_chunks(F.array(*[F.lit(str(i)) for i in range(45)]))).alias("c")).collect()
    assert [(r["c"][0], len(r["c"])) for r in chunks] == [("0", 24), ("18", 24), ("36", 9)]
    assert T.score_support(["a", "b"], ["x", "a", "b"]) == 1.0 and T.score_support([], ["a"]) == 0.0
    assert 0 < T.score_support("the red fox ran".split(), "a red fox walked home today".split()) < 1


def test_quotes(spark, segments):
    q = spark.createDataFrame([(1, "s", "Going to drill!"), (2, "s", "before adding the brass insert completely different words and more"), (3, "s", "nowhere to be found"), (4, "s", ""), (5, "t", "going to drill")], "quote_id int, stream_id string, quote string")
    got = {r["quote_id"]: r["second"] for r in T.align_quotes(q, T.caption_words(segments, order=("event",))).collect()}
    assert got == {1: 10, 2: 15, 3: None, 4: None, 5: None}


def test_refusals_and_cleaning(spark):
    rows = spark.createDataFrame([("Sorry, I can’t assist with that", "p"), ("x\nAsk me\n\n p q \nanswer", "p q")], "t string, p string")
    got = rows.select(C.is_refusal(F.col("t")).alias("a"), C.clean_response(F.col("t"), F.col("p"), ["Ask me"]).alias("b")).collect()
    assert got[0]["a"] and not got[1]["a"] and got[1]["b"] == "answer"


def test_reanalysis(spark):
    schema = "candidate_window_id string, stream_id int, is_favorite boolean, review_status string, processing_status string, reviewer_notes string"
    active = spark.createDataFrame([("a", 1, False, "pending_review", "complete", ""), ("b", 2, True, "pending_review", "complete", ""), ("c", 3, False, "pending_review", "complete", "")], schema)
    expected = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3), ("y", 4)], "candidate_window_id string, stream_id int")
    runs = spark.createDataFrame([(1, "complete")], "stream_id int, status string")
    plan = {r["stream_id"]: (r["safe"], r["blockers"]) for r in K.reanalysis_plan(active, runs, expected, active.where("candidate_window_id = 'c'")).collect()}
    assert plan[1] == (True, []) and plan[2] == (False, ["b: favourite"]) and plan[3] == (False, ["candidate set changed", "c: has assets"])
    assert plan[4] == (False, ["no active candidates", "candidate set changed"])


def test_new_ids_keep_the_old_batch(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "candidate_window_id string")
    assert [r[0] for r in K.new_clip_ids(ids("a"), ids("a", "b"), ids("z")).collect()] == ["b"]
    assert [r[0] for r in K.new_clip_ids(ids("a"), ids("a"), ids("z")).collect()] == ["z"]
