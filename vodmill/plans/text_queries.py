"""Registered queries of the response parsers, CSV routing and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from vodmill.functions import metrics as M
from vodmill.operators import analytics as A
from vodmill.operators import captions as T
from vodmill.operators import responses as R
from vodmill.sources import files
from vodmill.sources.shared import stored
from vodmill.streaming import ingest
from vodmill.streaming.store import LivestreamStore

from . import bindings as B
from .analytics_queries import ROLLUP_SQL
from .library_queries import segments
from .registry import query, scratch, table


def native_texts(spark, sf_dir):
    """Two candidates a text, in four shapes: all labels, no scores at all, other order and case of labels, no "n." before the title."""
    p = table(spark, sf_dir, "part")
    at = lambda m: F.format_string("%02d:%02d", F.col("p_size") + m, F.col("p_partkey") % 60)
    kind = F.col("p_partkey") % 4

    def one(n: int, m: int, tag: str):
        head = F.concat(F.when(kind == 3, "").otherwise(f"{n}. "), F.col("p_name"), F.lit(" ("), at(m), F.lit(" - "), at(m + 5), F.lit(f")\nRank: {n}\n"))
        pillar, summary = F.lit("Primary Pillar: Humor & personality\n"), F.concat(F.lit("Summary: made of "), F.col("p_type"), F.lit("\n  more\n"))
        tags, hooks = F.concat(F.lit(f"Tags: {tag}, #"), F.col("p_brand"), F.lit("\n")), F.lit('Possible Hooks: "a b" / c\n')
        rest = F.lit("Window Type: source-window\nChatter Risk: low\nExact Caption Quote: so it is\nCompleteness Check: yes\n")
        scores = F.concat(F.lit("Component Scores: Hook: 99, Confidence: "), (F.col("p_partkey") % 100).cast("string"), F.lit("\nUsefulness Score: 77\n"))
        body = F.when(kind == 1, F.concat(pillar, summary, tags, hooks, rest)).when(kind == 2, F.concat(scores, rest, hooks, tags, summary, pillar)).otherwise(F.concat(pillar, summary, tags, hooks, rest, scores))
        return F.concat(head, body, F.lit("\n"))

    return p.select("p_partkey", F.concat(F.lit("Here it is\n"), one(1, 0, "x y"), one(2, 9, "z")).alias("text"))


@query("""SELECT p_partkey, i::INT AS position, p_name AS title, (p_size + i * 9) * 60 + p_partkey % 60 AS start_seconds, (p_size + i * 9 + 5) * 60 + p_partkey % 60 AS end_seconds, 'personal_journey_recovery' AS primary_pillar, 'made of ' || p_type || ' more' AS concise_summary,
 list_concat([CASE i WHEN 0 THEN 'x-y' ELSE 'z' END], string_split(lower(p_brand), '#')) AS tags, ['a b'] AS possible_hooks, CASE p_partkey % 4 WHEN 1 THEN 75 ELSE 99 END AS hook_strength, CASE p_partkey % 4 WHEN 1 THEN 70 ELSE p_partkey % 100 END::INT AS confidence, CASE p_partkey % 4 WHEN 1 THEN 80 ELSE 77 END AS editing_potential, true AS valid FROM part, range(2) t(i)""")
def t1_native_response(spark, sf_dir):
    out = R.parse_native_response(native_texts(spark, sf_dir))
    return out.select("p_partkey", "position", "title", "start_seconds", "end_seconds", "primary_pillar", "concise_summary", "tags", "possible_hooks", "scores.hook_strength", "scores.confidence", "scores.editing_potential", "valid")


def review_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    at = lambda s: F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    say = lambda n: F.when(F.col("turn") % n == 0, "No").otherwise("Yes")
    s = F.col("turn") * 4
    quote = F.array_join(F.slice(T.normalized_words(F.col("text")), 1, 6), " ")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("quote_id"), F.col("conv_id").alias("stream_id"), "turn", F.concat(
        F.lit("Clip one ("), at(s), F.lit(" - "), at(s + 40), F.lit(")\nRank: 1\nScore: 8"), (F.col("turn") % 10).cast("string"), F.lit("/100\nComplete Thought: "), say(2), F.lit("\nStandalone: "), say(3),
        F.lit("\nVisual Only: no\nExact Caption Quote: "), quote, F.lit("\nNo rank (01:00 - 02:00)\nSummary: left out\n")).alias("text"))


@query("""SELECT concat_ws('-', conv_id, turn) AS quote_id, 'Clip one' AS title, '8' || turn % 10 || '/100' AS score, list_filter([CASE WHEN turn % 2 = 0 THEN 'incomplete_thought' END, CASE WHEN turn % 3 = 0 THEN 'not_standalone' END], lambda x: x IS NOT NULL) AS local_flags,
 CASE WHEN turn % 3 = 0 THEN 'reject_or_manual_rescue' WHEN turn % 2 = 0 THEN 'reject' ELSE 'candidate_ok' END AS local_recommendation FROM conversations""")
def t2_structured_final(spark, sf_dir):
    return R.parse_structured_final(review_texts(spark, sf_dir)).select("quote_id", "title", "score", "local_flags", "local_recommendation")


T3_SQL = r"""WITH w0 AS (SELECT conv_id AS stream_id, turn, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conversations),
 wl AS (SELECT stream_id, flatten(list(w ORDER BY turn)) AS ws, flatten(list([turn * 4 FOR x IN w] ORDER BY turn)) AS ss FROM w0 GROUP BY 1),
 q AS (SELECT concat_ws('-', stream_id, turn) AS quote_id, stream_id, turn, w[1:6] AS need FROM w0),
 g AS (SELECT stream_id, i, ss[i] AS second, ws[i:i + 5] AS gram FROM wl, unnest(range(1, len(ws) + 1)) t(i)),
 best AS (SELECT quote_id, arg_min(second, i) AS second FROM q JOIN g USING (stream_id) WHERE len(need) > 0 AND gram[1:len(need)] = need GROUP BY 1),
 x AS (SELECT quote_id, turn * 4 AS s0, turn * 4 + 40 AS e, second, 80 + turn % 10 AS score, turn % 2 = 0 AS cut, turn % 3 = 0 AS bound FROM q LEFT JOIN best USING (quote_id)),
 n AS (SELECT *, CASE WHEN second IS NULL THEN '' WHEN second BETWEEN s0 AND e THEN 'verified' WHEN second BETWEEN s0 - 15 AND s0 - 1 THEN 'start-adjusted-to-caption-quote' ELSE 'caption-quote-outside-window' END AS note,
  CASE WHEN second BETWEEN s0 - 15 AND s0 - 1 THEN second ELSE s0 END AS start_seconds FROM x),
 r AS (SELECT *, note IN ('verified', 'start-adjusted-to-caption-quote') AS sure, list_filter([CASE WHEN cut THEN 'incomplete-thought' END, CASE WHEN bound THEN 'not-standalone' END, CASE WHEN note NOT IN ('', 'verified') THEN note END,
  CASE WHEN note NOT IN ('verified', 'start-adjusted-to-caption-quote') THEN 'caption-quote-needs-verification' END], lambda t: t IS NOT NULL) AS risks FROM n)
SELECT quote_id, 'Clip one' AS title, start_seconds::BIGINT AS start_seconds, e::BIGINT AS end_seconds, (e - start_seconds)::BIGINT AS duration_seconds, 'artistic_process' AS primary_pillar,
 ['artistic-process', 'short-ready', 'native-youtube-structured-v1', CASE WHEN bound THEN 'reject-or-manual-rescue' WHEN cut THEN 'reject' ELSE 'candidate-ok' END] AS tags, risks,
 CASE WHEN len(risks) > 0 THEN 'needs_verification' ELSE 'pending_review' END AS review_status, sure AS caption_quote_verified, 1 AS estimated_short_count,
 least(100, score + 2)::INT AS hook_strength, CASE WHEN cut OR bound THEN least(score, 70) ELSE score END::INT AS standalone_clarity, 88 AS audio_clarity, 72 AS educational_value, CASE WHEN cut OR bound THEN 82 ELSE 92 END AS confidence FROM r"""


@query(T3_SQL)
def t3_structured_candidates(spark, sf_dir):
    # the reviews are needed at five places, their quotes among them: they are parsed once
    reviews = stored(R.parse_structured_final(review_texts(spark, sf_dir)).drop("text"), "reviews")
    quotes = reviews.select("quote_id", "stream_id", F.col("exact_caption_quote").alias("quote"))
    words = T.caption_grams(segments(spark, sf_dir), order=("event",))
    out = R.structured_candidates(reviews.drop("stream_id"), T.align_quotes(quotes, words))
    scores = ("hook_strength", "standalone_clarity", "audio_clarity", "educational_value", "confidence")
    return out.select(*[c for c in out.columns if c != "scores"], *[F.col(f"scores.{c}").alias(c) for c in scores])


@query("SELECT concat('vid', p_partkey) AS video_id, 'final' AS artifact_type, strlen(p_name) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT concat('vid', p_partkey), 'prompts', strlen('{\"a\":\"watch?v=vid' || p_partkey || '&t=1\"}') FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0 UNION ALL SELECT concat('vid', p_partkey), 'prompts', strlen('{\"a\":\"watch?v=vid' || p_partkey || '&t=1\"}') FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1")
def io7_structured_pass(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    folder = F.concat(F.lit("file:/passes/"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit("vid"), key, F.lit("_20260801_101010"))))
    a = p.where("p_partkey % 2 = 0").select(F.concat(folder, F.lit("/final.txt")).alias("path"), F.col("p_name").alias("text"))
    b = p.where("p_partkey % 3 = 0").select(F.concat(folder, F.lit("/prompts.json")).alias("path"), F.concat(F.lit('{"a":"watch?v=vid'), key, F.lit('&t=1"}')).alias("text"))
    other = p.select(F.concat(folder, F.lit("/notes.txt")).alias("path"), F.lit("x").alias("text"))
    out = R.structured_pass_rows(a.unionByName(b).unionByName(other))
    return out.select("video_id", "artifact_type", F.octet_length("text").cast("long").alias("n"))


@query(f"""WITH {B.METRIC_SQL} SELECT 'daily' AS kind, count(*) AS n, sum(views)::BIGINT AS total FROM raw WHERE s2 < 5 UNION ALL SELECT 'series', count(*), sum(channel_id * 60 + s2)::BIGINT FROM raw WHERE s2 >= 5 UNION ALL SELECT 'video', count(DISTINCT video), 0 FROM raw""")
def t4_csv_routing(spark, sf_dir):
    r = B.metric_rows(spark, sf_dir)
    timed = F.col("seq2") >= 5
    path = scratch(spark, "routing")
    r.select(F.date_format(F.col("day").cast("date"), "M/d/yyyy").alias("Date"), F.col("video").alias("Video ID"), F.col("video").alias("Video title"), F.col("creatorContentType").alias("Content type"),
             F.col("liveOrOnDemand").alias("Live or on demand"), F.col("views").cast("string").alias("Views"), F.when(timed, F.concat_ws(":", "channel_id", F.lpad(F.col("seq2").cast("string"), 2, "0"))).otherwise("").alias("Livestream position"),
             (F.col("seq") * 10 + F.col("seq2")).alias("seq")).write.option("header", True).csv(path)
    rows = files.read_metrics_csv(spark, path)
    daily, series, videos = A.route_csv(rows.withColumn("seq", F.col("seq").cast("long")))
    zero = F.lit(0).cast("long")
    return daily.agg(F.lit("daily").alias("kind"), F.count("*").alias("n"), F.sum("views").alias("total")).unionByName(
        series.agg(F.lit("series").alias("kind"), F.count("*").alias("n"), F.sum("stream_position_seconds").alias("total"))).unionByName(
        videos.agg(F.lit("video").alias("kind"), F.count("*").alias("n"), zero.alias("total")))


@query("SELECT strftime(greatest(DATE '1996-01-01', max(o_orderdate::DATE) FILTER (o_orderstatus = 'F') - 3), '%Y-%m-%d') AS start, '2000-01-01' AS end, greatest(DATE '1996-01-01', max(o_orderdate::DATE) FILTER (o_orderstatus = 'F') - 3) > DATE '2000-01-01' AS no_op FROM orders")
def st1_incremental_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = o.select(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("status"), F.col("o_orderdate").cast("date").alias("last_successful_date"))
    return ingest.incremental_window(log, "1996-01-01", "2000-01-01")


FIRST_DAY = "1996-06-01"


def ingested(spark, sf_dir, with_series: bool) -> LivestreamStore:
    """A store that took lineitem's rows, and the events, in micro-batches."""
    store = LivestreamStore(spark, scratch(spark, "store"), B.BATCH_ORDER, span=7)
    # a task's rows in eight files by hash, three eighths of all files a batch: late rows of a key come in batches before earlier ones
    source = scratch(spark, "stream-in")
    B.metric_rows(spark, sf_dir).withColumn("drop", F.pmod(F.xxhash64("seq", "seq2"), F.lit(8)).cast("int")).write.partitionBy("drop").parquet(source)
    written = spark.read.parquet(source)
    rows = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", max(1, -(-3 * len(written.inputFiles()) // 8))).parquet(source).drop("drop")
    ingest.ingest_daily(rows, FIRST_DAY, store, scratch(spark, "stream-mark")).awaitTermination()
    if with_series:
        points = scratch(spark, "stream-in")
        B.timeseries_rows(spark, sf_dir).repartition(4, F.xxhash64("seq")).write.parquet(points)
        rows = spark.readStream.schema(spark.read.parquet(points).schema).option("maxFilesPerTrigger", 2).parquet(points)
        starts = B.videos(spark, sf_dir).select("video_id", M.parse_datetime(F.col("published_at")).alias("actual_start"))
        ingest.ingest_series(rows, starts, store, scratch(spark, "stream-mark")).awaitTermination()
    return store


@query(f"WITH {B.METRIC_SQL} SELECT day AS date, video AS video_id, ct AS content_type, lod AS live_or_on_demand, views FROM daily WHERE day >= '{FIRST_DAY}'")
def st2_streaming_upsert(spark, sf_dir):
    return ingested(spark, sf_dir, False).daily().select(*A.DAILY_KEY, "views")


@query(f"WITH {ROLLUP_SQL.replace('FROM daily GROUP BY video', f"FROM daily WHERE day >= '{FIRST_DAY}' GROUP BY video")} SELECT * FROM roll")
def st2_livestream_rollup(spark, sf_dir):
    out = ingested(spark, sf_dir, True).rollup()
    return out.withColumn("average_concurrent", F.round("average_concurrent", 4))
