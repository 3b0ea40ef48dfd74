"""Registered queries of the caption, library and vector operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vodmill.functions import candidates as C
from vodmill.operators import captions as T
from vodmill.operators import library as L
from vodmill.operators import vectors as V
from vodmill.sources import files
from vodmill.sources.shared import located

from .registry import query, scratch, table

SEG_SQL = r"""
seg AS (SELECT conv_id AS stream_id, turn AS event, turn * 4000 AS start_ms, turn * 4000 + 4000 AS end_ms, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM conversations WHERE trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) <> '')
"""


#: Turns of a conversation in a caption text, orders in a report, and files in a folder of media: each grows in number with the table, not in size.
CAPTION_TURNS, REPORT_ORDERS, FOLDER_FILES = 1024, 4096, 4096


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON3 text per conversation and range of CAPTION_TURNS turns: (stream_id, chunk, json)."""
    c = table(spark, sf_dir, "conversations")
    event = F.struct((F.col("turn") * 4000).alias("tStartMs"), F.lit(4000).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    g = c.groupBy("conv_id", F.floor(F.col("turn") / CAPTION_TURNS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", event.alias("e")))).alias("x"))
    return g.select(F.col("conv_id").alias("stream_id"), "chunk", F.to_json(F.struct(F.col("conv_id").alias("stream"), F.transform("x", lambda x: x["e"]).alias("events"))).alias("json"))


def written(rows: DataFrame, path: str, suffix: str) -> None:
    """A file per row (name, content) below the folder ``path``; a name may have folders.

    A file appears whole: it is written beside the folder and moved. So a repeated task writes the
    same again, and one that ends halfway, or goes on after it was given up, harms no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = located(path)
        beside, made = f"{place}-unfinished", set()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                target = f"{place}/{name}{suffix}"
                for folder in {beside, target.rpartition("/")[0]} - made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(own := f"{beside}/{uuid.uuid4().hex}", compression=None) as f:
                    f.write(content)
                store.move(own, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("event"), (F.col("turn") * 4000).alias("start_ms"), (F.col("turn") * 4000 + 4000).alias("end_ms"),
                    F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).where("text != ''")


@query(f"WITH {SEG_SQL} SELECT stream_id, start_ms, end_ms, text FROM seg")
def io3_caption_json3(spark, sf_dir):
    path = scratch(spark, "captions")
    written(caption_files(spark, sf_dir).select(F.concat_ws("-", "stream_id", "chunk").alias("name"), F.col("json").alias("content")), path, ".json3")
    found = files.read_caption_json3(spark, path)
    return found.select(F.split("file", "-")[0].cast("long").alias("stream_id"), "start_ms", "end_ms", "text")


@query(r"""WITH c AS (SELECT conv_id AS stream_id, turn, CASE WHEN turn * 4 >= 3600 THEN printf('%02d:%02d:%02d', turn * 4 // 3600, turn * 4 // 60 % 60, turn * 4 % 60) ELSE printf('%02d:%02d', turn * 4 // 60, turn * 4 % 60) END || ' ' || text AS line
 FROM conversations WHERE trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) <> '') SELECT stream_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM c GROUP BY 1""")
def io4_caption_plain_text(spark, sf_dir):
    path = scratch(spark, "captions")
    written(caption_files(spark, sf_dir).select(F.concat_ws("-", "stream_id", "chunk").alias("name"), F.col("json").alias("content")), path, ".json3")
    # the text of a stream is one row by definition; its captions are read event by event
    place = F.split(F.regexp_replace("file", r"\.json3$", ""), "-")
    lines = files.read_caption_lines(spark, path).select(place[0].cast("long").alias("stream_id"), F.struct(place[1].cast("long").alias("chunk"), "event", "line").alias("x"))
    return lines.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS date, l_extendedprice AS revenue, l_quantity * 60 AS minutes FROM lineitem")
def io1_read_metrics_csv(spark, sf_dir):
    from vodmill.functions import metrics as M

    li = table(spark, sf_dir, "lineitem")
    path = scratch(spark, "metrics")
    # two exports whose columns differ in order and number
    rows = li.select("l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("Video ID"), F.date_format("l_shipdate", "MMM d, yyyy").alias("Date"),
                     F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("Estimated revenue ($)"), F.col("l_quantity").cast("string").alias("Watch time (hours)"))
    rows.where("l_linenumber % 2 = 0").drop("l_linenumber").write.option("header", True).csv(f"{path}/a")
    rows.where("l_linenumber % 2 = 1").select("Watch time (hours)", F.lit("x").alias("Note"), "Date", "Estimated revenue ($)", "Video ID").write.option("header", True).csv(f"{path}/b")
    df = files.read_metrics_csv(spark, f"{path}/*")
    ids = F.split("video_id", "-")
    return df.select(*[ids[i].cast(t).alias(c) for i, (c, t) in enumerate((("l_orderkey", "long"), ("l_linenumber", "int"), ("l_partkey", "long"), ("l_suppkey", "long")))],
                     M.normalize_date(F.col("date")).alias("date"), M.csv_number(F.col("estimated_revenue_")).alias("revenue"),
                     M.watch_minutes(F.lit(""), F.col("watch_time_hours"), F.lit("")).alias("minutes"))


@query("SELECT l_orderkey % 50 AS report, count(*) AS n, sum(l_quantity)::BIGINT AS views FROM lineitem GROUP BY 1")
def io2_read_report_json(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    heads = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("video", "views", "report")])
    row = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), (F.col("l_orderkey") % 50).cast("string"))
    g = li.groupBy(F.floor(F.col("l_orderkey") / REPORT_ORDERS).alias("r")).agg(F.collect_list(row).alias("rows"))
    path = scratch(spark, "report")
    g.select(F.to_json(F.struct(heads.alias("columnHeaders"), "rows")).alias("value"), "r").write.partitionBy("r").text(path)
    out = files.read_report_json(spark, path)
    return out.groupBy(F.element_at("record", "report").cast("long").alias("report")).agg(F.count("*").alias("n"), F.sum(F.element_at("record", "views").cast("long")).alias("views"))


@query("""SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 2 = 0 THEN 'video' ELSE 'image' END AS media_kind, strlen(text) AS size_bytes, sha256(text) AS checksum, false AS failed FROM documents WHERE doc_id % 3 <> 2
 UNION ALL SELECT 'gone-' || doc_id, 'video', 5, NULL, true FROM documents WHERE doc_id % 50 = 0""")
def io5_scan_media(spark, sf_dir):
    """A file per document, scanned and hashed; files that are gone when their turn comes are outcomes.

    A file's name has the document's row behind its id, so documents of one id have a file each.
    A document without a text is no file: it has neither size nor checksum.
    """
    d = table(spark, sf_dir, "documents")
    path = scratch(spark, "inbox")
    wanted = F.coalesce(F.col("doc_id") % 3 != 2, F.lit(False))
    kind = F.when(F.col("doc_id") % 2 == 0, "video").otherwise("image")
    row = F.monotonically_increasing_id()
    name = F.concat(F.floor(row / FOLDER_FILES).cast("string"), F.lit("/"), F.concat_ws("~", F.col("doc_id").cast("string"), row.cast("string")), F.when(~wanted, ".txt").when(kind == "video", ".mp4").otherwise(".PNG"))
    written(d.select(name.alias("name"), F.col("text").alias("content")).where("content IS NOT NULL"), path, "")
    media = files.scan_media(spark, path)
    name = F.concat(F.lit("gone-"), F.col("doc_id").cast("string"), F.lit("~.mp4"))
    gone = d.where("doc_id % 50 = 0").select(name.alias("source_path"), F.lit("video").alias("media_kind"), F.lit(5).cast("long").alias("size_bytes"), F.concat(F.lit(f"{path}/"), name).alias("path"))
    out = files.with_checksums(media.unionByName(gone, allowMissingColumns=True))
    out = out.select(F.regexp_extract("source_path", r"([^/~]+)~\d*\.[^.]+$", 1).alias("name"), "media_kind", "size_bytes", F.col("checksum_sha256").alias("checksum"), F.col("error").isNotNull().alias("failed"))
    empty = d.where(F.col("text").isNull() & wanted)
    return out.unionByName(empty.select(F.col("doc_id").cast("string").alias("name"), kind.alias("media_kind"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("checksum"), F.lit(False).alias("failed")))


@query("SELECT p_partkey, p_size AS start_seconds, p_size + 60 AS end_seconds, (1 + p_partkey % 2)::INT AS candidate_rank FROM part")
def io6_candidate_responses(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("start_seconds"), (F.col("p_size") + 60).alias("end_seconds"), F.lit("artistic_process").alias("primary_pillar"))
    other = F.struct(F.lit("other").alias("title"), F.lit(0).alias("start_seconds"), F.lit(1).alias("end_seconds"), F.lit("x").alias("primary_pillar"))
    one = F.concat(F.lit("```json\n"), F.to_json(F.struct(c.alias("candidate"))), F.lit("\n```"))
    many = F.to_json(F.struct(F.array(other, c).alias("candidates")))
    rows = p.select("p_partkey", files.parse_candidate_response(F.when(F.col("p_partkey") % 2 == 0, one).otherwise(many)).alias("c"))
    out = rows.select("p_partkey", F.posexplode("c").alias("i", "c")).where("c.title != 'other'")
    return out.select("p_partkey", F.col("c.start_seconds").cast("int").alias("start_seconds"), F.col("c.end_seconds").cast("int").alias("end_seconds"), (F.col("i") + 1).alias("candidate_rank"))


def small_cands(spark, sf_dir):
    """A candidate per caption turn: its excerpt is that turn's text, every third one taken from another turn."""
    c = table(spark, sf_dir, "conversations")
    far = F.col("turn") % 3 == 2
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("candidate_window_id"), F.col("conv_id").alias("stream_id"), F.when(far, F.col("turn") * 4 + 900).otherwise(F.col("turn") * 4).alias("start_seconds"),
                    F.when(far, F.col("turn") * 4 + 930).otherwise(F.col("turn") * 4 + 6).alias("end_seconds"), F.col("text").alias("transcript_excerpt"),
                    F.array().cast("array<struct<timestamp:string,seconds:bigint,text:string>>").alias("transcript_evidence"))


@query(f"""WITH {SEG_SQL}, c AS (SELECT concat_ws('-', conv_id, turn) AS candidate_window_id, conv_id AS stream_id, CASE WHEN turn % 3 = 2 THEN turn * 4 + 900 ELSE turn * 4 END AS s, CASE WHEN turn % 3 = 2 THEN turn * 4 + 930 ELSE turn * 4 + 6 END AS e FROM conversations)
 SELECT candidate_window_id, event FROM c JOIN seg ON c.stream_id = seg.stream_id AND start_ms <= (e + 5) * 1000 AND end_ms >= greatest(s - 5, 0) * 1000""")
def j5_interval_join(spark, sf_dir):
    return T.interval_join(small_cands(spark, sf_dir), segments(spark, sf_dir), 5, 5).select("candidate_window_id", "event")


def _quotes(spark, sf_dir):
    b, c = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    words = T.normalized_words(F.col("text"))
    own = c.select(F.concat_ws("-", "conv_id", "turn").alias("quote_id"), F.col("conv_id").alias("stream_id"), F.array_join(F.slice(words, 2, 4 + F.col("turn") % 8), " ").alias("quote"))
    return own.unionByName(b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("quote_id"), (F.col("item_id") % 50).alias("stream_id"), F.col("text").alias("quote")))


WORDS_SQL = r"""w0 AS (SELECT conv_id AS stream_id, turn, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conversations),
 wl AS (SELECT stream_id, flatten(list(w ORDER BY turn)) AS ws, flatten(list([turn * 4 FOR x IN w] ORDER BY turn)) AS ss FROM w0 GROUP BY 1),
 q AS (SELECT concat_ws('-', stream_id, turn) AS quote_id, stream_id, w[2:5 + turn % 8] AS need FROM w0 UNION ALL SELECT 'b' || item_id, item_id % 50, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') FROM benchmark),
 g AS (SELECT stream_id, i, ss[i] AS second, ws[i:i + 7] AS gram FROM wl, unnest(range(1, len(ws) + 1)) t(i)),
 hit AS (SELECT quote_id, 0 AS r, i, second FROM q JOIN g USING (stream_id) WHERE len(need) > 0 AND gram[1:least(len(need), 8)] = need[1:8] UNION ALL SELECT quote_id, 1, i, second FROM q JOIN g USING (stream_id) WHERE len(need) > 8 AND gram[1:5] = need[1:5]),
 best AS (SELECT quote_id, arg_min(second, (r, i)) AS second FROM hit GROUP BY 1)"""


@query(f"WITH {WORDS_SQL} SELECT q.quote_id, second FROM q LEFT JOIN best ON q.quote_id = best.quote_id")
def j6_w5_align_quotes(spark, sf_dir):
    words = T.caption_grams(segments(spark, sf_dir), order=("event",))
    return T.align_quotes(_quotes(spark, sf_dir), words).select("quote_id", "second")


@query(f"WITH {WORDS_SQL}, v AS (SELECT q.quote_id, length(q.quote_id) * 3 AS s, second FROM q LEFT JOIN best ON q.quote_id = best.quote_id) SELECT quote_id, CASE WHEN second BETWEEN s - 15 AND s - 1 THEN second ELSE s END AS start, CASE WHEN second IS NULL THEN '' WHEN second BETWEEN s AND s + 30 THEN 'caption_quote_verified' WHEN second BETWEEN s - 15 AND s - 1 THEN 'start_adjusted_to_caption_quote' ELSE 'caption_quote_outside_window' END AS note FROM v")
def j7_quote_verdict(spark, sf_dir):
    words = T.caption_grams(segments(spark, sf_dir), order=("event",))
    out = T.align_quotes(_quotes(spark, sf_dir), words)
    s = (F.length("quote_id") * 3).cast("long")
    start, note = T.quote_verdict(s, s + 30, F.col("second"))
    return out.select("quote_id", start.alias("start"), note.alias("note"))


@query(f"WITH {WORDS_SQL} SELECT stream_id, i - 1 AS place, second, gram FROM g")
def w5_word_ngrams(spark, sf_dir):
    from pyspark.sql import Window

    grams = T.caption_grams(segments(spark, sf_dir), order=("event",))
    w = Window.partitionBy("stream_id").orderBy("place")
    return grams.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("place"), "second", "gram")


def audit_cands(spark, sf_dir):
    """A candidate per caption turn, whose claims plain SQL can judge.

    By turn % 5: the turn's own text; words that no caption holds; both; evidence with
    timestamps, of either kind; a stream without captions.
    """
    c = table(spark, sf_dir, "conversations")
    kind, own, other = F.col("turn") % 5, F.col("text"), F.lit("Zqa zqb zqc zqd zqe.")
    timed = F.when(F.col("conv_id") % 2 == 0, own).otherwise(other)
    entry = F.array(F.struct(F.lit("").alias("timestamp"), (F.col("turn") * 4).cast("bigint").alias("seconds"), timed.alias("text")))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("candidate_window_id"), F.when(kind == 4, F.col("conv_id") + 1_000_000_000).otherwise(F.col("conv_id")).alias("stream_id"),
        (F.col("turn") * 4).alias("start_seconds"), (F.col("turn") * 4 + 6).alias("end_seconds"),
        F.when(kind == 1, other).when(kind == 2, F.concat(own, F.lit("\n"), other)).when(kind == 3, "").otherwise(own).alias("transcript_excerpt"),
        F.when(kind == 3, entry).otherwise(F.array().cast("array<struct<timestamp:string,seconds:bigint,text:string>>")).alias("transcript_evidence"))


def token_sql(text: str) -> str:
    """The evidence tokens of Latin text: folded, digit groups joined, units spelled out."""
    low = f"replace(replace(lower({text}), 'ß', 'ss'), '’', chr(39))"
    joined = rf"regexp_replace(regexp_replace({low}, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g')"
    for unit, name in (("v", "volts"), ("ma", "milliamps")):
        joined = rf"regexp_replace({joined}, '(^|[^\pL\pN_])([0-9]+)\s*{unit}($|[^\pL\pN_])', '\1\2 {name}\3', 'g')"
    return f"regexp_extract_all({joined}, '[a-z0-9]+(?:''[a-z]+)?')"


def chunk_sql(source: str) -> str:
    """CTE ``chunk`` (key, i, j, words): the claim chunks of ``source`` (key, claim)."""
    return rf"""sent AS (SELECT key, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM (SELECT key, list_filter(string_split_regex(claim, '[.!?;\n]+'), lambda x: trim(x) <> '') AS ss FROM {source})),
 tok AS (SELECT key, i, {token_sql('s')} AS w FROM sent),
 chunk AS (SELECT key, i, j, w[j * 18 + 1 : j * 18 + 24] AS words FROM (SELECT key, i, w, unnest(range(CASE WHEN len(w) < 3 THEN 0 WHEN len(w) <= 24 THEN 1 ELSE (len(w) - 7) // 18 + 1 END)) AS j FROM tok) WHERE len(w) - j * 18 >= 3)"""


#: The claims of ``audit_cands`` and what is to be found for each: the number of chunks and of supported ones.
AUDIT_SQL = rf"""k AS (SELECT concat_ws('-', conv_id, turn) AS key, conv_id, turn, turn % 5 AS kind, text, turn % 5 = 3 AS timed FROM conversations),
 ex AS (SELECT *, CASE kind WHEN 1 THEN 'Zqa zqb zqc zqd zqe.' WHEN 2 THEN text || chr(10) || 'Zqa zqb zqc zqd zqe.' WHEN 3 THEN '' ELSE text END AS excerpt FROM k),
 cl AS (SELECT key, CASE WHEN timed THEN CASE WHEN conv_id % 2 = 0 THEN text ELSE 'Zqa zqb zqc zqd zqe.' END ELSE excerpt END AS claim FROM ex),
 {chunk_sql('cl')},
 per AS (SELECT key, count(*) AS chunks, count(*) FILTER (words[1] <> 'zqa') AS supported FROM chunk JOIN ex USING (key) WHERE kind <> 4 GROUP BY key),
 base AS (SELECT ex.key, CASE WHEN kind = 4 THEN conv_id + 1000000000 ELSE conv_id END AS stream_id, kind <> 4 AS has, timed, len({token_sql('excerpt')}) = 0 AS quiet, coalesce(chunks, 0) AS chunks, coalesce(supported, 0) AS supported FROM ex LEFT JOIN per USING (key))"""


def audit_sql(strict: bool) -> str:
    legacy = "WHEN quiet THEN 'pass' ELSE 'fail'" if strict else "WHEN quiet THEN 'pass' WHEN chunks = 0 THEN 'unverifiable' WHEN supported = chunks THEN 'pass' WHEN supported = 0 THEN 'unverifiable' ELSE 'fail'"
    return f"""WITH {AUDIT_SQL} SELECT key AS candidate_window_id, stream_id, CASE WHEN NOT has THEN '{'pass' if strict else 'unverifiable'}' WHEN timed THEN CASE WHEN supported = chunks THEN 'pass' ELSE 'fail' END {legacy} END AS status,
 chunks, supported, CASE WHEN chunks > supported THEN [(chunks - supported) || ' of ' || chunks || ' claims lack support'] ELSE CAST([] AS VARCHAR[]) END AS issues FROM base"""


@query(f"SELECT conv_id, turn, {token_sql('text')} AS tokens FROM conversations")
def s17_evidence_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens("text").alias("tokens"))


@query(f"WITH src AS (SELECT concat_ws('-', conv_id, turn) AS key, text AS claim FROM conversations), {chunk_sql('src')} SELECT CAST(split_part(key, '-', 1) AS BIGINT) AS conv_id, CAST(split_part(key, '-', 2) AS BIGINT) AS turn, CAST(i AS INT) AS i, CAST(j AS INT) AS j, array_to_string(words, ' ') AS words FROM chunk")
def s17_s18_claim_chunks(spark, sf_dir):
    return T.with_chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").where("chunk IS NOT NULL").select("conv_id", "turn", "chunk_no.i", "chunk_no.j", F.array_join("chunk", " ").alias("words"))


@query(f"WITH {SEG_SQL}, o AS (SELECT *, lead(start_ms, k) OVER (PARTITION BY stream_id ORDER BY event) AS last_ms, k FROM seg, range(12) t(k)), p AS (SELECT a.stream_id, a.event, k + 1 AS length FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY event) AS rn FROM seg) a JOIN (SELECT stream_id, start_ms AS later, row_number() OVER (PARTITION BY stream_id ORDER BY event) AS rn2 FROM seg) b ON a.stream_id = b.stream_id, range(12) t(k) WHERE rn2 = rn + k AND later <= start_ms + 30000) SELECT stream_id, event, length::INT AS length FROM p")
def w4_evidence_windows(spark, sf_dir):
    return T.evidence_windows(segments(spark, sf_dir)).select("stream_id", "event", "length")


@query(f"WITH {AUDIT_SQL} SELECT chunk.key AS candidate_window_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN words[1] = 'zqa' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM chunk JOIN ex USING (key) WHERE kind < 3")
def q2_support_score(spark, sf_dir):
    """The support of every claim chunk by the captions around its candidate."""
    c = audit_cands(spark, sf_dir).where("transcript_excerpt != '' AND stream_id < 1000000000")
    chunks = T.with_chunks(c.select("candidate_window_id", F.col("transcript_excerpt").alias("claim")), "claim").where("chunk IS NOT NULL").select("candidate_window_id", "chunk_no", "chunk")
    near = T.contexts(c, segments(spark, sf_dir))
    return chunks.join(near, "candidate_window_id", "left").select("candidate_window_id", "chunk_no.i", "chunk_no.j", T.support_score("chunk", "context").alias("score"))


@query()
def q2_near_claims(spark, sf_dir):
    """The support of claims that are nearly what was said: a turn's words, every seventh replaced and some swapped with their neighbour. No SQL measures them; a test does."""
    c = table(spark, sf_dir, "conversations")
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    changed = F.transform(words, lambda w, i: F.when(i % 7 == F.col("turn") % 7, F.lit("zqa")).when(i % 5 == 1, F.coalesce(F.get(words, i + 1), w)).when(i % 5 == 2, F.get(words, i - 1)).otherwise(w))
    c = c.select(F.concat_ws("-", "conv_id", "turn").alias("candidate_window_id"), F.col("conv_id").alias("stream_id"), (F.col("turn") * 4).alias("start_seconds"), (F.col("turn") * 4 + 6).alias("end_seconds"),
                 F.array_join(changed, " ").alias("claim"))
    chunks = T.with_chunks(c.select("candidate_window_id", "claim"), "claim").where("chunk IS NOT NULL").select("candidate_window_id", "chunk_no", "chunk")
    near = T.contexts(c, segments(spark, sf_dir))
    return chunks.join(near, "candidate_window_id", "left").select("candidate_window_id", "chunk_no.i", "chunk_no.j", F.round(T.support_score("chunk", "context"), 9).alias("score"))


@query(audit_sql(False))
def q2_q3_audit_evidence(spark, sf_dir):
    return T.audit_evidence(audit_cands(spark, sf_dir), segments(spark, sf_dir))


@query(audit_sql(True))
def q4_validate_evidence(spark, sf_dir):
    return T.audit_evidence(audit_cands(spark, sf_dir), segments(spark, sf_dir), require_timed=True)


@query(f"SELECT status, count(*) AS n FROM ({audit_sql(False)}) GROUP BY status")
def a13_audit_summary(spark, sf_dir):
    return T.audit_evidence(audit_cands(spark, sf_dir), segments(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {SEG_SQL}, {AUDIT_SQL}, need AS (SELECT ex.key, conv_id, turn, kind FROM ex WHERE kind <> 3 AND trim(excerpt) <> ''),
 win AS (SELECT need.key, seg.event, seg.start_ms, seg.text, array_to_string({token_sql('seg.text')}, ' ') AS words FROM need JOIN seg ON kind <> 4 AND seg.stream_id = conv_id AND seg.start_ms BETWEEN turn * 4000 AND turn * 4000 + 6000),
 best AS (SELECT chunk.key, i, j, arg_min((start_ms // 1000) || ':' || text, (length(text), event)) FILTER (contains(win.words, array_to_string(chunk.words, ' '))) AS b FROM chunk JOIN need USING (key) LEFT JOIN win ON win.key = chunk.key GROUP BY chunk.key, i, j),
 told AS (SELECT key, bool_and(b IS NOT NULL) AS grounded, list(b ORDER BY i, j) AS said FROM best GROUP BY key)
 SELECT key AS candidate_window_id, grounded, CASE WHEN grounded THEN list_filter(said, lambda x, n: n = list_position(said, x)) END AS evidence FROM told""")
def q5_ground_evidence(spark, sf_dir):
    out = T.ground_evidence(audit_cands(spark, sf_dir), segments(spark, sf_dir))
    return out.withColumn("evidence", F.transform("evidence", lambda e: F.concat_ws(":", e["seconds"].cast("string"), e["text"])))


def media(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("media_id"), F.concat(F.lit("inbox/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("source_path"), F.octet_length("text").cast("long").alias("size_bytes"),
                    (F.col("doc_id") % 7).alias("source_modified_ns"), F.sha2(F.col("text"), 256).alias("checksum_sha256"), F.col("n_chars").cast("double").alias("duration_seconds"),
                    F.when(F.col("lang") == "fr", "image").when(F.col("lang") == "de", "audio").otherwise("video").alias("media_kind"), F.col("source").alias("title"),
                    F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".MP4")).alias("filename"), F.col("doc_id").alias("created_at"), F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("new").alias("index_status"))


MEDIA_SQL = "media AS (SELECT doc_id::VARCHAR AS media_id, 'inbox/' || doc_id || '.mp4' AS source_path, strlen(text) AS size_bytes, doc_id % 7 AS source_modified_ns, sha256(text) AS checksum_sha256, n_chars::DOUBLE AS duration_seconds, CASE lang WHEN 'fr' THEN 'image' WHEN 'de' THEN 'audio' ELSE 'video' END AS media_kind, source AS title, source || '-' || doc_id || '.MP4' AS filename, doc_id FROM documents)"


@query("""SELECT p_partkey, sha256('youtube-source-id:' || p_partkey) AS fingerprint, sha256('{"a_model":"' || p_brand || '","n":' || p_size || ',"z":null}') AS config, p_brand || '@' || left(p_name, 12) || '#' || left(p_type, 12) AS generation,
 'visual/' || p_partkey || '/' || left(sha256(concat_ws(chr(10), p_brand, '1', p_type)), 12) || '/' || lpad(p_size::VARCHAR, 12, '0') || '.jpg' AS path FROM part""")
def s28_s31_identities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    return p.select("p_partkey", L.source_fingerprint(key).alias("fingerprint"), L.config_hash(z=F.lit(None).cast("string"), n=F.col("p_size"), a_model=F.col("p_brand")).alias("config"),
                    L.generation_id(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("generation"), L.artifact_path(key, F.col("p_brand"), F.lit("1"), F.col("p_type"), F.col("p_size")).alias("path"))


_INGEST_SQL = f"""{MEDIA_SQL}, known AS (SELECT *, size_bytes + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS os FROM media WHERE doc_id % 3 = 0), owner AS (SELECT checksum_sha256 AS ck, min(media_id) AS holder FROM known GROUP BY 1),
 f AS (SELECT m.source_path, m.checksum_sha256, k.media_id AS own, holder, k.media_id IS NOT NULL AND m.size_bytes = k.os AS same, holder IS NOT NULL AND (k.media_id IS NULL OR holder <> k.media_id) AS held FROM media m LEFT JOIN known k ON m.source_path = k.source_path LEFT JOIN owner ON m.checksum_sha256 = ck),
 x AS (SELECT *, min(source_path) FILTER (NOT same AND NOT held) OVER (PARTITION BY checksum_sha256) AS first_path FROM f),
 outcome AS (SELECT source_path, CASE WHEN same OR held OR source_path <> first_path THEN 'skipped' WHEN own IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome FROM x)"""


def _ingest(spark, sf_dir):
    m = media(spark, sf_dir)
    known = m.where("created_at % 3 = 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("created_at") % 5 == 0, 1).otherwise(0))
    return L.ingest(m.select("source_path", "size_bytes", "source_modified_ns", "checksum_sha256"), known)


@query(f"WITH {_INGEST_SQL} SELECT * FROM outcome")
def l1_ingest_media(spark, sf_dir):
    return _ingest(spark, sf_dir).select("source_path", "outcome")


@query(f"WITH {_INGEST_SQL} SELECT count(*) AS considered, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, 0 AS reused, count(*) FILTER (outcome = 'skipped') AS skipped, 0 AS repaired, 0 AS error FROM outcome")
def a11_ingest_counters(spark, sf_dir):
    return L.outcome_counts(_ingest(spark, sf_dir))


@query("SELECT o_orderkey AS stream_id, sha256('youtube-source-id:' || o_orderkey) AS checksum_sha256, nullif(o_orderkey % 7200, 0)::DOUBLE AS duration_seconds, 'Stream ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' END AS note, CASE WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'created' END AS outcome FROM orders")
def l2_sync_stream_media(spark, sf_dir):
    from . import bindings as B

    s = B.streams(spark, sf_dir)
    old = s.where("stream_id % 2 = 0").select(F.lit("stream").alias("source_type"), F.col("source_video_id").alias("source_id"), F.create_map(F.lit("note"), F.lit("kept"), F.lit("title"), F.lit("old")).alias("metadata"))
    out = L.sync_stream_media(s, old)
    return out.select("stream_id", "checksum_sha256", "duration_seconds", F.try_element_at("metadata", F.lit("title")).alias("title"), F.try_element_at("metadata", F.lit("note")).alias("note"), "outcome")


_PLAN_SQL = f"""{MEDIA_SQL}, iv AS (SELECT *, greatest(CASE WHEN duration_seconds <= 60 THEN 5 WHEN duration_seconds <= 600 THEN 10 WHEN duration_seconds <= 3600 THEN 30 ELSE 60 END, ceil(duration_seconds / 240)::BIGINT) AS interval_seconds FROM media),
 ts AS (SELECT media_id, media_kind, CASE WHEN media_kind = 'video' THEN interval_seconds END AS interval_seconds, CASE media_kind WHEN 'image' THEN [0::BIGINT] WHEN 'video' THEN CASE WHEN duration_seconds <= 0 THEN [0::BIGINT] ELSE range(0, (duration_seconds * 1000)::BIGINT, interval_seconds * 1000) END ELSE [] END AS timestamps_ms FROM iv)"""


@query(f"WITH {_PLAN_SQL} SELECT * FROM ts")
def l3_sampling_plan(spark, sf_dir):
    return L.sampling_plan(media(spark, sf_dir)).select("media_id", "media_kind", "interval_seconds", "timestamps_ms")


@query(f"WITH {_PLAN_SQL} SELECT count(*) AS media, count(*) FILTER (media_kind = 'video') AS videos, count(*) FILTER (media_kind = 'image') AS images, sum(len(timestamps_ms))::BIGINT AS expected_traces FROM ts")
def a14_sampling_summary(spark, sf_dir):
    return L.sampling_summary(L.sampling_plan(media(spark, sf_dir)))


@query(f"WITH {_PLAN_SQL}, e AS (SELECT media_id, unnest(timestamps_ms) AS start_ms FROM ts) SELECT media_id, start_ms, CASE WHEN start_ms % 20000 = 0 AND media_id::BIGINT % 2 = 0 THEN CASE WHEN media_id::BIGINT % 4 = 0 THEN 'reuse' ELSE 'repair' END ELSE 'create' END AS outcome FROM e")
def l4_trace_plan(spark, sf_dir):
    plan = L.sampling_plan(media(spark, sf_dir))
    frames = plan.select("media_id", F.explode("timestamps_ms").alias("start_ms")).where("start_ms % 20000 = 0 AND CAST(media_id AS BIGINT) % 2 = 0")
    traces = frames.select("*", F.lit("visual").alias("trace_type"), F.lit("ffmpeg").alias("extractor"), F.lit("1").alias("extractor_version"), F.lit("c").alias("configuration_hash"))
    stored = frames.where("CAST(media_id AS BIGINT) % 4 = 0").select(L.artifact_path(F.col("media_id"), F.lit("ffmpeg"), F.lit("1"), F.lit("c"), F.col("start_ms")).alias("artifact_path"))
    return L.trace_plan(plan, traces, stored, "ffmpeg", "1", "c").select("media_id", "start_ms", "outcome")


@query(f"WITH {SEG_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY stream_id, least(start_ms, 20000) ORDER BY text) AS n FROM seg) SELECT CASE WHEN stream_id % 2 = 0 AND start_ms < 20000 OR n > 1 THEN 'reused' ELSE 'created' END AS outcome, count(*) AS n FROM b GROUP BY 1")
def l5_import_language_traces(spark, sf_dir):
    s = segments(spark, sf_dir)
    t = s.select(F.col("stream_id").alias("media_id"), F.lit("language").alias("trace_type"), F.least("start_ms", F.lit(20000)).alias("start_ms"), F.least("start_ms", F.lit(20000)).alias("end_ms"), F.lit("json3").alias("extractor"), F.lit("1").alias("extractor_version"),
                 F.lit("h").alias("configuration_hash"), F.col("text").alias("content_text"))
    return L.import_traces(t, t.where("media_id % 2 = 0 AND start_ms < 20000")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {_PLAN_SQL}, x AS (SELECT i.media_id, i.interval_seconds AS iv, (i.duration_seconds * 1000)::BIGINT AS len, least(greatest(doc_id * 997 % 90000, 0), greatest((i.duration_seconds * 1000)::BIGINT - 1, 0)) AS c FROM iv i WHERE media_kind = 'video' AND duration_seconds > 0),
 y AS (SELECT *, greatest(c - (least(greatest(iv / 2, 2.5), 30) * 1000)::BIGINT, 0) AS lo, least(len - 1, c + (least(greatest(iv / 2, 2.5), 30) * 1000)::BIGINT) AS hi FROM x),
 z AS (SELECT *, greatest((least(greatest(iv / 10, 0.5), 2) * 1000)::BIGINT, ceil((hi - lo) / 30)::BIGINT) AS step FROM y) SELECT media_id, step AS step_ms, len(range(lo, hi + 1, step)[1:31]) AS n, true AS has_coarse FROM z""")
def l6_refinement_plan(spark, sf_dir):
    m = L.sampling_plan(media(spark, sf_dir)).withColumn("coarse_ms", F.col("created_at") * 997 % 90000)
    out = L.refinement_plan(m).where("frames_ms IS NOT NULL")
    c = F.least("coarse_ms", F.greatest(F.col("duration_seconds").cast("long") * 1000 - 1, F.lit(0)))
    return out.select("media_id", "step_ms", F.size("frames_ms").cast("long").alias("n"), F.array_contains("frames_ms", c).alias("has_coarse"))


@query(f"WITH {MEDIA_SQL} SELECT media_id, left(checksum_sha256, 12) AS checksum FROM media WHERE (contains(lower(title), 'src1') OR contains(lower(filename), 'src1')) AND media_kind = 'video' AND doc_id % 2 = 0 ORDER BY doc_id DESC LIMIT 100")
def f5_media_inventory(spark, sf_dir):
    return L.media_inventory(media(spark, sf_dir), "SRC1", "video", "ready").select("media_id", "checksum")


@query("""WITH s AS (SELECT conv_id, turn, turn * 4000 - CASE WHEN turn % 4 = 3 THEN 9000 ELSE 0 END AS a, turn * 4000 + CASE WHEN turn % 5 = 4 THEN -20000 ELSE 4000 END AS b, turn * 0.2 AS c FROM conversations), t AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM s)
 SELECT conv_id, turn, list_filter([CASE WHEN a < 0 THEN 'negative start' END, CASE WHEN b < a THEN 'end before start' END, CASE WHEN p > a THEN 'out of order' END, CASE WHEN c > 1 THEN 'confidence out of range' END], lambda v: v IS NOT NULL) AS errors FROM t""")
def q6_validate_transcription(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    rows = c.select("conv_id", "turn", (t * 4000 - F.when(t % 4 == 3, 9000).otherwise(0)).alias("start_ms"), (t * 4000 + F.when(t % 5 == 4, -20000).otherwise(4000)).alias("end_ms"), F.lit("x").alias("text"), (t * F.lit(0.2)).alias("confidence"), F.lit("en").alias("language"))
    return L.validate_transcription(rows, "conv_id", "turn").select("conv_id", "turn", "errors")


def stored_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("trace_id"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model_id"), F.size("embedding").alias("embedding_dimension"), F.col("embedding").alias("vector"), F.lit(True).alias("normalized"))


def trace_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("trace_id"), F.col("label").cast("string").alias("media_id"), (F.col("vec_id") * 1000).alias("start_ms"), F.when(F.col("vec_id") % 11 == 0, "language").otherwise("visual").alias("trace_type"))


@query("SELECT vec_id, 64 AS dim, true AS same, round(sqrt(list_sum([x::DOUBLE * x FOR x IN embedding])), 4) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def s29_s30_vector_codec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("blob", V.encode_vector(F.col("embedding")))
    back = V.decode_vector(F.col("blob"), F.size("embedding"))
    e = e.withColumn("back", back).withColumn("u", V.l2_normalize(F.col("embedding")))
    norm = lambda c: F.round(F.sqrt(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)), 4)
    return e.select("vec_id", (F.octet_length("blob") / 4).cast("int").alias("dim"), (F.col("back") == F.col("embedding")).alias("same"), norm("embedding").alias("norm"), norm("u").alias("unit"))


@query("SELECT vec_id AS trace_id, label::VARCHAR AS media_id FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 11 <> 0")
def j8_generation(spark, sf_dir):
    return V.generation(stored_vectors(spark, sf_dir), trace_rows(spark, sf_dir), "m1", 64).select("trace_id", "media_id")


@query("SELECT vec_id AS trace_id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 11 <> 0")
def j10_missing_embeddings(spark, sf_dir):
    return V.missing_embeddings(trace_rows(spark, sf_dir), stored_vectors(spark, sf_dir), "m1", 64).select("trace_id")


def _queries(spark, sf_dir):
    """The stated query set of the searches: every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_COS = """u AS (SELECT vec_id, d, [x::DOUBLE FOR x IN embedding[1:d]] AS v FROM embeddings, (SELECT unnest([{dims}]) AS d)), n AS (SELECT vec_id, d, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM u),
 s AS (SELECT b.d AS dimension, a.vec_id AS query_id, b.vec_id AS trace_id, round(greatest(-1, least(1, list_dot_product(a.v, b.v) / a.norm / b.norm)), 8) AS score FROM n a JOIN n b ON a.d = b.d WHERE a.vec_id % 100 = 0 AND {where}),
 r AS (SELECT *, row_number() OVER (PARTITION BY dimension, query_id ORDER BY score DESC, trace_id) AS rank FROM s)"""


@query("WITH " + _COS.format(dims="64", where="b.vec_id % 2 = 1 AND b.vec_id % 11 <> 0") + " SELECT query_id, rank::INT AS rank, trace_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def k3_cosine_top_k(spark, sf_dir):
    g = V.generation(stored_vectors(spark, sf_dir), trace_rows(spark, sf_dir), "m1", 64)
    return V.cosine_top_k(g, _queries(spark, sf_dir), 10).select("query_id", "rank", "trace_id", F.round("score", 6).alias("score"))


@query("WITH " + _COS.format(dims="64, 32, 16, 8", where="true") + " SELECT dimension::INT AS dimension, query_id, rank::INT AS rank, trace_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def k4_evaluate_dimensions(spark, sf_dir):
    rows = stored_vectors(spark, sf_dir)
    return V.cosine_top_k(rows, _queries(spark, sf_dir), 10, [64, 32, 16, 8]).select("dimension", "query_id", "rank", "trace_id", F.round("score", 6).alias("score"))


@query("WITH " + _COS.format(dims="64", where="b.vec_id % 2 = 1 AND b.vec_id % 11 <> 0") + " SELECT query_id, trace_id, label::VARCHAR AS media_id, trace_id * 1000 AS start_ms FROM r JOIN embeddings e ON e.vec_id = trace_id WHERE rank <= 10")
def j9_present_matches(spark, sf_dir):
    g = V.generation(stored_vectors(spark, sf_dir), trace_rows(spark, sf_dir), "m1", 64)
    top = V.cosine_top_k(g, _queries(spark, sf_dir), 10)
    return V.present(top, trace_rows(spark, sf_dir), media(spark, sf_dir)).select("query_id", "trace_id", "media_id", "start_ms")


@query("SELECT label AS coarse_id, vec_id AS timestamp_ms, vec_id - label * 10 AS offset_ms, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 1) DESC, vec_id)::INT AS rank FROM embeddings QUALIFY rank <= 5")
def k5_refine_ranking(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    f = e.select(F.col("label").alias("coarse_id"), F.col("vec_id").alias("timestamp_ms"), (F.col("label") * 10).alias("coarse_ms"), F.round(F.element_at("embedding", 1).cast("double"), 1).alias("score"))
    return V.refine_ranking(f, 5).select("coarse_id", "timestamp_ms", "offset_ms", "rank")


@query("SELECT vec_id AS trace_id, 4 AS dim, 1.0::DOUBLE AS norm FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 11 <> 0")
def l7_embed_missing(spark, sf_dir):
    import numpy as np

    missing = V.missing_embeddings(trace_rows(spark, sf_dir), stored_vectors(spark, sf_dir), "m1", 64)
    out = V.embed_missing(missing, lambda: lambda xs: np.array([[1.0, float(x), 2.0, 3.0] for x in xs]), "toy", 4, "start_ms")
    n = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return out.select("trace_id", F.col("embedding_dimension").alias("dim"), F.round(n, 4).alias("norm"))
