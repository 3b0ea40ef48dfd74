"""Registered queries of the analytics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vodmill.functions import metrics as M
from vodmill.operators import analytics as A

from . import bindings as B
from .registry import query, table

START, END = "1997-01-15", "1998-06-30"
TOTALS_SQL = """coalesce(sum(revenue), 0)::DOUBLE AS revenue, coalesce(sum(views), 0)::BIGINT AS views, coalesce(sum(minutes), 0) AS watch_minutes,
  coalesce(sum(minutes), 0) / 60 AS watch_hours, coalesce(sum(likes), 0)::BIGINT AS likes, coalesce(sum(gained), 0)::BIGINT AS subscribers_gained,
  coalesce(sum(lost), 0)::BIGINT AS subscribers_lost, (coalesce(sum(gained), 0) - coalesce(sum(lost), 0))::BIGINT AS subscriber_net,
  CASE WHEN coalesce(sum(views), 0) <> 0 THEN sum(revenue)::DOUBLE / sum(views) * 1000 ELSE 0 END AS rpm"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.upsert(None, A.normalize_daily(B.metric_rows(spark, sf_dir)), A.DAILY_KEY, B.BATCH_ORDER).drop(*B.BATCH_ORDER)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = B.videos(spark, sf_dir).select("video_id", M.parse_datetime(F.col("published_at")).alias("actual_start"))
    return A.upsert(None, A.timeseries(B.timeseries_rows(spark, sf_dir), starts), A.SERIES_KEY, ["seq"]).drop("seq")


@query(f"WITH {B.METRIC_SQL} SELECT day AS date, video AS video_id, ct AS content_type, lod AS live_or_on_demand, views, minutes AS watch_minutes, avd AS average_view_duration, likes, gained AS subscribers_gained, lost AS subscribers_lost, revenue::DOUBLE AS estimated_revenue FROM daily")
def x1_upsert_daily(spark, sf_dir):
    d = daily(spark, sf_dir).drop("channel_id")
    return d.withColumn("estimated_revenue", F.col("estimated_revenue").cast("double"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS first_value, l_extendedprice AS csv_number, -l_quantity AS csv_negative, strftime(l_shipdate, '%Y-%m-%d') AS day_us, strftime(l_shipdate, '%Y-%m-%d') AS day_iso,
 (l_suppkey % 60) * 60 + l_linenumber AS mmss, 3600 * (l_linenumber % 5) + (l_suppkey % 60) * 60 + l_linenumber AS hhmmss FROM lineitem""")
def s1_s4_parse_fields(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    mm, ss, hh = pad(F.col("l_suppkey") % 60), pad(F.col("l_linenumber")), (F.col("l_linenumber") % 5).cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        M.first_value(F.lit(""), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string"))).cast("long").alias("first_value"),
        M.csv_number(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))).alias("csv_number"),
        M.csv_number(F.concat(F.lit("("), F.col("l_quantity").cast("string"), F.lit(")"))).alias("csv_negative"),
        M.normalize_date(F.date_format("l_shipdate", "MMM d, yyyy")).alias("day_us"), M.normalize_date(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day_iso"),
        M.duration_to_seconds(F.concat_ws(":", mm, ss)).alias("mmss"), M.duration_to_seconds(F.concat_ws(":", hh, mm, ss)).alias("hhmmss"),
    )


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 0 WHEN user_id % 4 = 1 THEN NULL ELSE user_id END AS position,
 CASE WHEN user_id % 2 = 0 AND value <> 0 THEN value WHEN user_id % 2 <> 0 AND user_id % 3 = 0 AND value <> 0 THEN value * 60 ELSE user_id END AS minutes,
 CASE user_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'live' WHEN 2 THEN 'vod' ELSE CASE WHEN user_id BETWEEN 1 AND 60 THEN 'short' ELSE 'vod' END END AS content_type,
 CASE user_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'on_demand' ELSE 'unknown' END AS mode, trunc(value)::BIGINT AS whole,
 CASE WHEN value <> 0 THEN user_id / value * 1000 ELSE 0 END AS rpm, CASE WHEN value <> 0 THEN (user_id - value) / value * 100 END AS delta,
 user_id * 60 + 7 AS iso_seconds, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events""")
def s5_s13_classify_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u, v, text = F.col("user_id"), F.col("value"), lambda c: c.cast("string")
    blank = F.lit("")
    return e.select(
        "event_id", M.stream_position(blank, F.when(u % 4 == 0, "00:00").when(u % 4 == 1, "0:00").otherwise(text(u))).alias("position"),
        M.watch_minutes(F.when(u % 2 == 0, text(v)).otherwise(blank), F.when((u % 2 != 0) & (u % 3 == 0), text(v)).otherwise(blank), text(u)).alias("minutes"),
        M.content_type(F.when(u % 4 == 0, "SHORTS").when(u % 4 == 1, "LIVE_STREAM").when(u % 4 == 2, "Video on demand").otherwise(""), u, F.lit(False)).alias("content_type"),
        M.live_or_on_demand(F.when(u % 3 == 0, "Subscribed Live").when(u % 3 == 1, "Replay").otherwise("x")).alias("mode"), M.lenient_long(text(v)).alias("whole"),
        M.rpm(u.cast("double"), v).alias("rpm"), M.percent_delta(u.cast("double"), v).alias("delta"),
        M.iso8601_duration(F.concat(F.lit("PT"), text(u), F.lit("M7S"))).alias("iso_seconds"),
        F.unix_seconds(M.parse_datetime(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("epoch"),
    )


@query(f"WITH {B.METRIC_SQL} SELECT day AS date, video AS video_id, ct AS content_type, lod AS live_or_on_demand, views FROM daily WHERE day BETWEEN '{START}' AND '{END}'")
def f1_metrics_between(spark, sf_dir):
    return A.between(daily(spark, sf_dir), START, END).select(*A.DAILY_KEY, "views")


@query(f"WITH {B.VIDEO_SQL} SELECT * FROM videos WHERE content_type = 'live' AND published_at BETWEEN '{START}' AND '{END}T23:59:59'")
def f7_livestreams_in_range(spark, sf_dir):
    return A.livestreams_in_range(B.videos(spark, sf_dir), START, END)


@query(f"WITH {B.METRIC_SQL} SELECT {TOTALS_SQL} FROM daily")
def a1_summarize_daily(spark, sf_dir):
    return A.summarize(daily(spark, sf_dir))


@query(f"WITH {B.METRIC_SQL} SELECT day AS date, {TOTALS_SQL} FROM daily GROUP BY day")
def a2_daily_chart(spark, sf_dir):
    return A.daily_chart(daily(spark, sf_dir))


@query(f"WITH {B.METRIC_SQL} SELECT ct AS content_type, {TOTALS_SQL}, coalesce(sum(avd * views) / nullif(sum(views), 0), 0) AS average_view_duration, list_position(['short','live','vod','unknown'], ct)::INT AS position FROM daily GROUP BY ct")
def a3_content_type_breakdown(spark, sf_dir):
    return A.content_type_breakdown(daily(spark, sf_dir))


@query(f"WITH {B.METRIC_SQL} SELECT day AS date, ct AS content_type, {TOTALS_SQL}, CASE WHEN grouping(day, ct) = 3 THEN 'total' WHEN grouping(day, ct) = 1 THEN 'day' ELSE 'type' END AS part FROM daily WHERE day BETWEEN '{START}' AND '{END}' GROUP BY GROUPING SETS ((), (day), (ct))")
def a4_overview(spark, sf_dir):
    return A.overview(daily(spark, sf_dir), START, END)


_NAMES = {"views": "views", "watch_minutes": "minutes", "likes": "likes", "subscribers_gained": "gained", "subscribers_lost": "lost", "estimated_revenue": "revenue"}
_SUMS = ", ".join(f"coalesce(sum({c}) FILTER (day BETWEEN '{START}' AND '{END}'), 0)::DOUBLE AS current_{n}, coalesce(sum({c}) FILTER (day BETWEEN '1997-01-01' AND '1997-01-14'), 0)::DOUBLE AS previous_{n}" for n, c in _NAMES.items())
_DELTAS = ", ".join(f"(current_{n} - previous_{n}) / nullif(previous_{n}, 0) * 100 AS {n}_delta" for n in _NAMES)


@query(f"WITH {B.METRIC_SQL}, s AS (SELECT {_SUMS} FROM daily) SELECT *, {_DELTAS} FROM s")
def a5_period_comparison(spark, sf_dir):
    return A.period_comparison(daily(spark, sf_dir), START, END)


@query(f"""WITH {B.METRIC_SQL}, s AS (SELECT coalesce(sum(revenue) FILTER (day BETWEEN '1998-06-01' AND '1998-06-12'), 0)::DOUBLE AS mtd,
 sum(revenue) FILTER (day BETWEEN '1998-06-06' AND '1998-06-12')::DOUBLE AS w7, sum(revenue) FILTER (day BETWEEN '1998-05-16' AND '1998-06-12')::DOUBLE AS w28 FROM daily)
 SELECT mtd, CASE WHEN mtd <> 0 THEN mtd / 12 * 30 END AS run_rate, mtd + w7 / 7 * 18 AS pace_7, mtd + w28 / 28 * 18 AS pace_28 FROM s""")
def a6_pace_forecast(spark, sf_dir):
    return A.pace_forecast(daily(spark, sf_dir), "1998-06-12")


ROLLUP_SQL = f"""{B.METRIC_SQL}, {B.SERIES_SQL}, da AS (SELECT video AS video_id, coalesce(sum(views) FILTER (lod = 'live'), 0)::BIGINT AS live_views,
 coalesce(sum(views) FILTER (lod = 'on_demand'), 0)::BIGINT AS replay_views, sum(views)::BIGINT AS total_views, sum(minutes) AS watch_minutes, sum(likes)::BIGINT AS likes,
 sum(gained)::BIGINT AS subscribers_gained, sum(revenue)::DOUBLE AS revenue FROM daily GROUP BY video),
 se AS (SELECT video_id, avg(CASE WHEN avg_v <> 0 THEN avg_v ELSE peak_v END)::DOUBLE AS average_concurrent, max(peak_v) AS peak_concurrent FROM series GROUP BY video_id),
 roll AS (SELECT coalesce(da.video_id, se.video_id) AS video_id, coalesce(live_views, 0) AS live_views, coalesce(replay_views, 0) AS replay_views, coalesce(total_views, 0) AS total_views,
 coalesce(watch_minutes, 0) AS watch_minutes, coalesce(likes, 0) AS likes, coalesce(subscribers_gained, 0) AS subscribers_gained, coalesce(revenue, 0) AS revenue,
 round(coalesce(average_concurrent, 0), 4) AS average_concurrent, coalesce(peak_concurrent, 0) AS peak_concurrent FROM da FULL JOIN se ON da.video_id = se.video_id)"""


@query(f"WITH {ROLLUP_SQL} SELECT * FROM roll")
def a7_livestream_rollup(spark, sf_dir):
    out = A.livestream_rollup(daily(spark, sf_dir), series(spark, sf_dir))
    return out.withColumn("average_concurrent", F.round("average_concurrent", 4))


@query(f"""WITH {ROLLUP_SQL}, {B.VIDEO_SQL} SELECT v.video_id, title, published_at, duration_seconds, coalesce(live_views, 0) AS live_views, coalesce(replay_views, 0) AS replay_views,
 coalesce(total_views, 0) AS total_views, coalesce(watch_minutes, 0) AS watch_minutes, coalesce(likes, 0) AS likes, coalesce(subscribers_gained, 0) AS subscribers_gained,
 coalesce(revenue, 0) AS revenue, round(coalesce(average_concurrent, 0), 4) AS average_concurrent, coalesce(peak_concurrent, 0) AS peak_concurrent
 FROM videos v LEFT JOIN roll r ON v.video_id = r.video_id WHERE content_type = 'live' AND published_at BETWEEN '{START}' AND '{END}T23:59:59'""")
def a8_livestream_summaries(spark, sf_dir):
    roll = A.livestream_rollup(daily(spark, sf_dir), series(spark, sf_dir)).withColumn("average_concurrent", F.round("average_concurrent", 4))
    return A.livestream_summaries(B.videos(spark, sf_dir), roll, START, END)


@query(f"WITH {B.SERIES_SQL} SELECT video_id, pos AS stream_position_seconds, peak_v AS peak_viewers, row_number() OVER (PARTITION BY video_id ORDER BY pos)::INT AS point FROM series")
def a8_livestream_timeline(spark, sf_dir):
    return A.livestream_timeline(series(spark, sf_dir)).select("video_id", "stream_position_seconds", "peak_viewers", "point")


@query("""SELECT l_partkey::VARCHAR AS video_id, arg_min(l_quantity::BIGINT, l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey) AS duration_seconds,
 coalesce(arg_max(l_shipdate::DATE::VARCHAR, l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey) FILTER (l_returnflag <> 'R'), '') AS title,
 coalesce(arg_max(CASE l_returnflag WHEN 'A' THEN 'short' ELSE 'live' END, l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey) FILTER (l_returnflag <> 'R'), 'unknown') AS content_type FROM lineitem GROUP BY 1""")
def a15_video_attributes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_partkey").cast("string").alias("video_id"), F.col("l_quantity").cast("long").alias("duration_seconds"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate").cast("date").cast("string")).otherwise(" ").alias("title"),
        F.when(F.col("l_returnflag") == "A", "short").when(F.col("l_returnflag") == "N", "live").otherwise("unknown").alias("content_type"),
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_suppkey")).alias("seq"))
    return A.video_attributes(rows, "seq")


@query(f"WITH {B.VIDEO_SQL}, {B.STREAM_SQL} SELECT v.video_id, s.stream_id FROM videos v LEFT JOIN streams s ON s.source_video_id = v.video_id")
def j1_video_stream_link(spark, sf_dir):
    return A.link_streams(B.videos(spark, sf_dir), B.streams(spark, sf_dir)).select("video_id", "stream_id")


@query(f"WITH {B.METRIC_SQL}, {B.VIDEO_SQL}, known AS (SELECT * FROM videos WHERE video_id::INT % 4 <> 0) SELECT video_id, title FROM known UNION ALL SELECT DISTINCT video, NULL FROM daily WHERE video NOT IN (SELECT video_id FROM known)")
def j2_metric_video_stubs(spark, sf_dir):
    known = B.videos(spark, sf_dir).where(F.col("video_id").cast("int") % 4 != 0)
    return A.with_stubs(daily(spark, sf_dir), known).select("video_id", "title")


@query(f"WITH {B.SERIES_SQL}, {B.VIDEO_SQL} SELECT s.video_id, pos AS stream_position_seconds, epoch(published_at::TIMESTAMP)::BIGINT + pos AS measured, CASE WHEN avg_v <> 0 THEN avg_v ELSE peak_v END::DOUBLE AS concurrent_viewers, peak_v AS peak_viewers FROM series s LEFT JOIN videos v ON s.video_id = v.video_id")
def j3_timeseries_start(spark, sf_dir):
    out = series(spark, sf_dir)
    return out.select("video_id", "stream_position_seconds", F.unix_seconds("measured_at").alias("measured"), F.col("concurrent_viewers").cast("double"), "peak_viewers")


@query(f"WITH {B.METRIC_SQL}, d AS (SELECT channel_id, day AS date, sum(revenue) AS r FROM raw GROUP BY 1, 2) SELECT channel_id, date, r::DOUBLE AS revenue, sum(r) OVER (PARTITION BY channel_id ORDER BY date::DATE RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::DOUBLE AS revenue_7, sum(r) OVER (PARTITION BY channel_id ORDER BY date::DATE RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)::DOUBLE AS revenue_28 FROM d")
def w6_trailing_revenue(spark, sf_dir):
    return A.trailing_revenue(A.normalize_daily(B.metric_rows(spark, sf_dir)), "channel_id")
