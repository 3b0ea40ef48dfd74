"""Analytics operators against known values."""

import pytest
from pyspark.sql import functions as F

from vodmill.functions import metrics as M
from vodmill.operators import analytics as A
from vodmill.sources import files
from vodmill.streaming import ingest

ROWS = [("2026-08-01", "live_1", "LIVE_STREAM", "LIVE", 100, 900.0, 20.0, 1), ("2026-08-02", "live_1", "LIVE_STREAM", "ON_DEMAND", 50, 200.0, 5.0, 2), ("2026-08-02", "short_1", "SHORTS", "ON_DEMAND", 1000, 100.0, 1.0, 3)]
SCHEMA = "day string, video string, creatorContentType string, liveOrOnDemand string, views long, estimatedMinutesWatched double, estimatedRevenue double, seq long"


@pytest.fixture(scope="module")
def daily(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("averageViewDuration", "likes", "subscribersGained", "subscribersLost"):
        rows = rows.withColumn(c, F.lit(None).cast("long"))
    return A.upsert(None, A.normalize_daily(rows), A.DAILY_KEY, ["seq"]).drop("seq")


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "number"), [("$1,234.50", 1234.5), ("12%", 12.0), ("(3)", -3.0), ("", 0.0), (None, 0.0), ("abc", 0.0), (" 7 ", 7.0)])
def test_csv_number(spark, text, number):
    assert one(spark, M.csv_number, text) == number


@pytest.mark.parametrize(("text", "day"), [("2026-08-01", "2026-08-01"), ("Aug 1, 2026", "2026-08-01"), ("August 1, 2026", "2026-08-01"), ("8/1/2026", "2026-08-01"), ("8/1/26", "2026-08-01"), ("2026-08-01T10:00:00Z", "2026-08-01"), ("x", ""), (None, ""), ("", "")])
def test_normalize_date(spark, text, day):
    assert one(spark, M.normalize_date, text) == day


@pytest.mark.parametrize(("text", "seconds"), [("90", 90), ("01:30", 90), ("1:01:30", 3690), ("01:30.9", 90), ("x", 0), ("", 0), (None, 0)])
def test_duration(spark, text, seconds):
    assert one(spark, M.duration_to_seconds, text) == seconds


@pytest.mark.parametrize(("text", "seconds"), [("0", 0), ("00:00", 0), ("0:00", None), ("00:01:00", 60), ("", None), (None, None), ("x", None)])
def test_stream_position(spark, text, seconds):
    assert one(spark, M.stream_position, text) == seconds


@pytest.mark.parametrize(("text", "seconds"), [("PT1H2M3S", 3723), ("PT45S", 45), ("PT", 0), ("1H", 0), ("", 0)])
def test_iso_duration(spark, text, seconds):
    assert one(spark, M.iso8601_duration, text) == seconds


def test_types(spark):
    got = spark.createDataFrame([("SHORTS", 0), ("LIVE_STREAM", 0), ("vod", 0), ("", 60), ("", 61), ("", 0)], "t string, d int").select(M.content_type(F.col("t"), F.col("d"), F.lit(False)).alias("x")).collect()
    assert [r["x"] for r in got] == ["short", "live", "vod", "short", "vod", "unknown"]
    assert one(spark, M.live_or_on_demand, "On Demand") == "on_demand" and one(spark, M.live_or_on_demand, "?") == "unknown"
    assert one(spark, lambda c: M.first_value(F.lit(""), c), "  ") == ""
    assert one(spark, M.lenient_long, "3.9") == 3 and one(spark, M.lenient_long, "nan") == 0


def test_totals(spark, daily):
    r = A.summarize(daily).first()
    assert (r["views"], r["revenue"], r["watch_minutes"]) == (1150, 26.0, 1200.0)
    assert [x["content_type"] for x in A.content_type_breakdown(daily).collect()] == ["short", "live"]
    empty = A.summarize(daily.limit(0)).first()
    assert (empty["views"], empty["rpm"], empty["revenue"]) == (0, 0.0, 0.0)


def test_overview_is_one_shuffle(daily):
    df = A.overview(daily, "2026-08-01", "2026-08-31")
    assert {(r["part"], r["date"], r["content_type"]): r["views"] for r in df.collect()} == {
        ("total", None, None): 1150, ("day", "2026-08-01", None): 100, ("day", "2026-08-02", None): 1050, ("type", None, "live"): 150, ("type", None, "short"): 1000}


def test_forecast(daily):
    r = A.pace_forecast(daily, "2026-08-02").first()
    assert r["mtd"] == 26.0 and r["run_rate"] == 403.0 and round(r["pace_7"], 6) == round(26 + 26 / 7 * 29, 6)
    none = A.pace_forecast(daily.limit(0), "2026-08-02").first()
    assert none["mtd"] == 0.0 and none["run_rate"] is None and none["pace_7"] is None


def test_comparison(daily):
    r = A.period_comparison(daily, "2026-08-02", "2026-08-02").first()
    assert (r["current_views"], r["previous_views"], r["views_delta"]) == (1050.0, 100.0, 950.0)


def test_upsert_last_wins_and_is_idempotent(spark):
    t = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, seq int")
    batch = spark.createDataFrame([("a", 5, 2), ("a", 4, 1), ("c", 9, 1)], "k string, v int, seq int")
    once = A.upsert(t, batch, ["k"], ["seq"])
    want = [("a", 5), ("b", 2), ("c", 9)]
    assert sorted((r["k"], r["v"]) for r in once.collect()) == want
    assert sorted((r["k"], r["v"]) for r in A.upsert(once, batch, ["k"], ["seq"]).collect()) == want


def test_livestream_rollup(spark, daily):
    rows = spark.createDataFrame([("live_1", 0, 12.0, 14, 1), ("live_1", 60, 20.0, 25, 2)], "video string, livestreamPosition long, averageConcurrentViewers double, peakConcurrentViewers long, seq long")
    starts = spark.createDataFrame([("live_1", "2026-08-01T10:00:00Z")], "video_id string, t string").select("video_id", M.parse_datetime(F.col("t")).alias("actual_start"))
    late = A.upsert(A.upsert(None, spark.createDataFrame([("a", 5, 9), ("b", 1, 1)], "k string, v long, seq long"), ["k"], ["seq"], across=True), spark.createDataFrame([("a", 4, 3), ("b", 2, 2)], "k string, v long, seq long"), ["k"], ["seq"], across=True)
    assert sorted((r["k"], r["v"]) for r in late.collect()) == [("a", 5), ("b", 2)]
    series = A.upsert(None, A.timeseries(rows, starts), A.SERIES_KEY, ["seq"])
    assert [str(r["measured_at"]) for r in series.orderBy("stream_position_seconds").collect()] == ["2026-08-01 10:00:00", "2026-08-01 10:01:00"]
    r = A.livestream_rollup(daily, series).where("video_id = 'live_1'").first()
    assert (r["live_views"], r["replay_views"], r["total_views"], r["average_concurrent"], r["peak_concurrent"]) == (100, 50, 150, 16.0, 25)


def test_csv_files(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text("﻿Date,Video ID,Video title,Content type,Live or on demand,Views,Watch time (hours),Average view duration,Likes,Estimated revenue,Livestream position\n"
                 '"Aug 1, 2026",v1,T,SHORTS,ON_DEMAND,"1,600",10,0:30,5,$32.50,\n8/2/2026,v2,U,LIVE_STREAM,LIVE,20,1,0:10,1,0.25,\n,v2,,,,,,,,,00:01:00\n', encoding="utf-8")
    rows = files.read_metrics_csv(spark, str(f))
    assert rows.columns[:2] == ["date", "video_id"]
    daily, series, videos = A.route_csv(rows.withColumn("seq", F.monotonically_increasing_id()))
    got = daily.agg(F.sum("views").alias("v"), F.sum("estimated_revenue").alias("r")).first()
    assert (got["v"], float(got["r"])) == (1620, 32.75)
    assert [(r["video_id"], r["stream_position_seconds"]) for r in series.collect()] == [("v2", 60)]
    assert {r["video_id"]: (r["title"], r["content_type"]) for r in videos.collect()} == {"v1": ("T", "short"), "v2": ("U", "live")}
    (tmp_path / "several").mkdir()
    for name, text in (("a", "Date,Views\n2024-01-01,5\n"), ("b", "\ufeffViews,Date,Likes\n7,2024-01-02,1\n"), ("c", "Date,Views\n\"2024-01-03\",9\n"), ("d", "Views (%),Date\n")):
        (tmp_path / "several" / f"{name}.csv").write_text(text, encoding="utf-8")
    several = files.read_metrics_csv(spark, str(tmp_path / "several" / "*.csv"))
    assert {tuple(r) for r in several.select("date", "views", "likes").collect()} == {("2024-01-01", "5", None), ("2024-01-02", "7", "1"), ("2024-01-03", "9", None)} and "views_pct" in several.columns
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "several" / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        files.read_metrics_csv(spark, str(tmp_path / "several" / "*.csv"))
    with pytest.raises(ValueError, match="no header"):
        files.read_metrics_csv(spark, str(tmp_path / "empty.csv"))


def test_incremental_window(spark):
    log = spark.createDataFrame([("complete", "2026-08-05"), ("failed", "2026-08-20")], "status string, last_successful_date string")
    assert tuple(ingest.incremental_window(log, "2026-01-01", "2026-08-10").first()) == ("2026-08-02", "2026-08-10", False)
    assert tuple(ingest.incremental_window(log.limit(0), "2026-01-01", "2026-08-10").first()) == ("2026-01-01", "2026-08-10", False)
    assert ingest.incremental_window(log, "2026-01-01", "2026-08-01").first()["no_op"]
