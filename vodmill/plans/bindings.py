"""The domain tables as views of the benchmark tables, by integer and string arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: Columns that order the rows of a metrics batch; later rows win.
BATCH_ORDER = ["seq", "seq2", "seq3", "seq4"]


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily report rows, as strings and numbers of a report."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_partkey").cast("string").alias("video"),
        F.when(F.col("l_returnflag") == "A", "SHORTS").when(F.col("l_returnflag") == "N", "LIVE_STREAM").otherwise("VIDEO_ON_DEMAND").alias("creatorContentType"),
        F.when(F.col("l_linestatus") == "F", "LIVE").otherwise("ON_DEMAND").alias("liveOrOnDemand"),
        F.col("l_quantity").cast("long").alias("views"), (F.col("l_quantity") * F.col("l_linenumber")).alias("estimatedMinutesWatched"),
        (F.col("l_quantity") % 7 * 10).alias("averageViewDuration"), F.col("l_linenumber").cast("long").alias("likes"),
        F.col("l_linenumber").cast("long").alias("subscribersGained"), (F.col("l_quantity") % 3).cast("long").alias("subscribersLost"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("estimatedRevenue"),
        F.col("l_suppkey").alias("channel_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("long").alias("seq2"),
        F.col("l_suppkey").alias("seq3"), F.col("l_extendedprice").alias("seq4"),
    )


#: The same rows for the SQL side.
METRIC_SQL = """
raw AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_partkey::VARCHAR AS video,
  CASE l_returnflag WHEN 'A' THEN 'short' WHEN 'N' THEN 'live' ELSE 'vod' END AS ct,
  CASE l_linestatus WHEN 'F' THEN 'live' ELSE 'on_demand' END AS lod,
  l_quantity::BIGINT AS views, l_quantity * l_linenumber AS minutes, l_quantity % 7 * 10 AS avd, l_linenumber::BIGINT AS likes,
  l_linenumber::BIGINT AS gained, (l_quantity % 3)::BIGINT AS lost, (l_extendedprice * (1 - l_discount))::DECIMAL(18,4) AS revenue,
  l_suppkey AS channel_id, l_orderkey AS s1, l_linenumber AS s2, l_suppkey AS s3, l_extendedprice AS s4 FROM lineitem),
daily AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY day, video, ct, lod ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC) = 1)
"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("stream_id"), F.lit("youtube").alias("platform"), F.col("o_orderkey").cast("string").alias("source_video_id"),
        F.concat(F.lit("Stream "), F.col("o_orderkey").cast("string")).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), (F.col("o_orderkey") % 7200).alias("duration_seconds"),
        F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed").alias("processing_status"),
    )


STREAM_SQL = """
streams AS (SELECT o_orderkey AS stream_id, 'youtube' AS platform, o_orderkey::VARCHAR AS source_video_id, 'Stream ' || o_orderkey AS title,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at, o_orderkey % 7200 AS duration_seconds,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' ELSE 'failed' END AS processing_status FROM orders)
"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("title"), (F.col("p_size") * 30).cast("long").alias("duration_seconds"),
        F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 2400).cast("int")), "yyyy-MM-dd'T00:00:00Z'").alias("published_at"),
        F.when(F.col("p_partkey") % 3 == 0, "live").when(F.col("p_partkey") % 3 == 1, "short").otherwise("vod").alias("content_type"),
    )


VIDEO_SQL = """
videos AS (SELECT p_partkey::VARCHAR AS video_id, p_name AS title, (p_size * 30)::BIGINT AS duration_seconds,
  strftime(DATE '1995-01-01' + (p_partkey % 2400)::INT, '%Y-%m-%dT00:00:00Z') AS published_at,
  CASE p_partkey % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'short' ELSE 'vod' END AS content_type FROM part)
"""


def timeseries_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("video"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("livestreamPosition"),
        F.col("value").cast("decimal(18,4)").alias("averageConcurrentViewers"), F.ceil("value").cast("long").alias("peakConcurrentViewers"), F.col("event_id").alias("seq"),
    )


SERIES_SQL = """
series AS (SELECT user_id::VARCHAR AS video_id, floor(epoch(ts))::BIGINT - 1704067200 AS pos, value::DECIMAL(18,4) AS avg_v, ceil(value)::BIGINT AS peak_v
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(epoch(ts)) ORDER BY event_id DESC) = 1)
"""

#: The score names and their default weights in hundredths.
SCORE_WEIGHTS = {
    "pillar_relevance": 10, "hook_strength": 14, "standalone_clarity": 12, "visual_quality": 12, "audio_clarity": 8,
    "emotional_impact": 10, "educational_value": 8, "entertainment_value": 8, "editing_potential": 14, "brand_fit": 4,
}
SCORES = [*SCORE_WEIGHTS, "confidence"]
#: The seven pillars.
PILLARS = [
    "motivational_inspirational", "personal_journey_recovery", "artistic_process", "explanation_education", "humor_personality",
    "mistakes_problem_solving", "emergent_miscellaneous",
]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip candidates with nested scores, tags and evidence."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    start = k % 3600
    scores = F.struct(*[((k * (i + 3) + n * (2 * i + 1)) % 101).cast("int").alias(s) for i, s in enumerate(SCORES)])
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_window_id"), F.col("l_orderkey").alias("stream_id"),
        F.col("l_orderkey").alias("analysis_run_id"), n.alias("candidate_rank"), start.alias("start_seconds"),
        (start + 60 + F.col("l_suppkey") % 300).alias("end_seconds"), F.col("p_name").alias("title"),
        F.element_at(F.array(*[F.lit(x) for x in PILLARS]), (k % 7 + 1).cast("int")).alias("primary_pillar"),
        F.array(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("raw_tags"), scores.alias("scores"),
        F.when(F.col("l_returnflag") == "A", "archived").when(F.col("l_returnflag") == "N", "pending_review").otherwise(
            F.when(n % 2 == 0, "approved").otherwise("needs_verification")).alias("review_status"),
        (k % 5 == 0).alias("is_favorite"),
    )


CANDIDATE_SQL = """
cand AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS candidate_window_id, l_orderkey AS stream_id,
  l_orderkey AS analysis_run_id, l_linenumber AS candidate_rank, l_partkey % 3600 AS start_seconds,
  l_partkey % 3600 + 60 + l_suppkey % 300 AS end_seconds, p_name AS title,
  ['motivational_inspirational','personal_journey_recovery','artistic_process','explanation_education','humor_personality','mistakes_problem_solving','emergent_miscellaneous'][(l_partkey % 7 + 1)::INT] AS primary_pillar,
  [p_brand, p_type, p_name] AS raw_tags,
  [((l_partkey * (i + 3) + l_linenumber * (2 * i + 1)) % 101)::INT FOR i IN range(11)] AS sc,
  CASE l_returnflag WHEN 'A' THEN 'archived' WHEN 'N' THEN 'pending_review' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'approved' ELSE 'needs_verification' END END AS review_status,
  l_partkey % 5 = 0 AS is_favorite FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
