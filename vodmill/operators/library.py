"""Media library: identities, inventory, ingest, sampling, traces and refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Interval seconds by duration, frames per video, and the bounds of a refinement.
BANDS = ((60, 5), (600, 10), (3600, 30))
WIDEST, MOST_FRAMES, MOST_LOCAL = 60, 240, 31
IDENTITY = ["media_id", "trace_type", "start_ms", "end_ms", "extractor", "extractor_version", "configuration_hash"]


def source_fingerprint(source_id: Column) -> Column:
    """Identity of a platform source."""
    return F.sha2(F.concat(F.lit("youtube-source-id:"), source_id), 256)


def config_hash(**fields: Column) -> Column:
    """sha256 of compact JSON with sorted keys; NULLs stay in it."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def generation_id(model: Column, revision: Column, config: Column) -> Column:
    return F.concat(model, F.lit("@"), F.substring(revision, 1, 12), F.lit("#"), F.substring(config, 1, 12))


def artifact_path(media_id: Column, name: Column, version: Column, config: Column, ms: Column, ext: str = "jpg") -> Column:
    """Relative path of a frame; NULL where a part could leave the root."""
    gen = F.substring(F.sha2(F.concat_ws("\n", name, version, config), 256), 1, 12)
    path = F.concat_ws("/", F.lit("visual"), media_id, gen, F.concat(F.lpad(ms.cast("string"), 12, "0"), F.lit(f".{ext}")))
    return F.when(~media_id.rlike(r"(^|/)\.\.(/|$)|^/"), path)


def ingest(files: DataFrame, media: DataFrame) -> DataFrame:
    """L1: outcome per scanned file: skipped (unchanged, or content owned by another row), updated or created.

    ``files``: source_path, size_bytes, source_modified_ns, checksum_sha256; ``media``: the known
    rows with media_id. Content hashes come from the reading stage, so no bytes are shuffled.
    Of new files with equal content the first path is created, the others are skipped. A
    file whose reading failed (``error``, where ``files`` has that column) is an error,
    unless its size and time say that it is unchanged; it stops no other.
    """
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    known = media.select("source_path", F.col("media_id").alias("own"), F.col("size_bytes").alias("old_size"), F.col("source_modified_ns").alias("old_ns"))
    owner = media.groupBy("checksum_sha256").agg(F.min("media_id").alias("holder"))
    out = files.join(known, "source_path", "left").join(owner, "checksum_sha256", "left")
    same = F.col("own").isNotNull() & (F.col("size_bytes") == F.col("old_size")) & (F.col("source_modified_ns") == F.col("old_ns"))
    held = F.col("holder").isNotNull() & (F.col("own").isNull() | (F.col("holder") != F.col("own")))
    failed = F.col("error").isNotNull()
    out = out.withColumn("fresh", ~same & ~held & ~failed)
    first = out.where("fresh").groupBy("checksum_sha256").agg(F.min("source_path").alias("first_path"))
    out = out.join(first, "checksum_sha256", "left")
    outcome = F.when(same, "skipped").when(failed, "error").when(held | (F.col("source_path") != F.col("first_path")), "skipped").when(F.col("own").isNotNull(), "updated").otherwise("created")
    return out.select("source_path", "checksum_sha256", outcome.alias("outcome"), "error")


def outcome_counts(df: DataFrame) -> DataFrame:
    """Rows per outcome, as columns."""
    names = ["created", "updated", "reused", "skipped", "repaired", "error"]
    return df.agg(F.count("*").alias("considered"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def sync_stream_media(streams: DataFrame, media: DataFrame, limit: int | None = None) -> DataFrame:
    """L2: metadata-only media of streams, newest first: merged metadata, created or updated; a duration of 0 is NULL."""
    s = streams.orderBy(F.desc("published_at"), "stream_id").limit(limit) if limit else streams
    old = media.where("source_type = 'stream'").select("source_id", F.col("metadata").alias("old"))
    new = F.map_from_arrays(F.array(F.lit("title"), F.lit("published_at")), F.array("title", "published_at"))
    s = s.select("stream_id", F.col("source_video_id").alias("source_id"), source_fingerprint(F.col("source_video_id")).alias("checksum_sha256"),
                 F.when(F.col("duration_seconds") != 0, F.col("duration_seconds").cast("double")).alias("duration_seconds"), new.alias("new"))
    out = s.join(old, "source_id", "left")
    kept = F.map_filter(F.coalesce("old", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("new", k))
    return out.select("stream_id", "source_id", "checksum_sha256", "duration_seconds", F.map_concat(kept, F.col("new")).alias("metadata"), F.when(F.col("old").isNull(), "created").otherwise("updated").alias("outcome"))


def sampling_interval(seconds: Column, fixed: int | None = None) -> Column:
    """Band by duration, widened so that no video has more than 240 frames."""
    if fixed:
        return F.lit(fixed).cast("long")
    band = F.when(seconds <= BANDS[0][0], BANDS[0][1]).when(seconds <= BANDS[1][0], BANDS[1][1]).when(seconds <= BANDS[2][0], BANDS[2][1]).otherwise(WIDEST)
    return F.greatest(band, F.ceil(seconds / MOST_FRAMES)).cast("long")


def sampling_plan(media: DataFrame, fixed: int | None = None) -> DataFrame:
    """L3: adds interval_seconds and timestamps_ms; images and unknown durations sample at 0, other kinds not at all."""
    d = F.col("duration_seconds")
    ms, step = F.bround(d * 1000, 0).cast("long"), sampling_interval(d, fixed) * 1000
    video = F.when(d.isNull() | (ms <= 0), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(ms - 1, F.lit(0)), step))
    stamps = F.when(F.col("media_kind") == "image", F.array(F.lit(0).cast("long"))).when(F.col("media_kind") == "video", video).otherwise(F.array().cast("array<bigint>"))
    return media.withColumn("interval_seconds", F.when((F.col("media_kind") == "video") & d.isNotNull(), sampling_interval(d, fixed))).withColumn("timestamps_ms", stamps)


def sampling_summary(plan: DataFrame) -> DataFrame:
    """A14."""
    return plan.agg(F.count("*").alias("media"), F.count_if(F.col("media_kind") == "video").alias("videos"), F.count_if(F.col("media_kind") == "image").alias("images"),
                    F.coalesce(F.sum(F.size("timestamps_ms")), F.lit(0)).alias("expected_traces"))


def trace_plan(plan: DataFrame, traces: DataFrame, artifacts: DataFrame, extractor: str, version: str, config: str) -> DataFrame:
    """L4: a row per planned frame: reuse, repair (trace without its file) or create."""
    want = plan.select("media_id", F.explode("timestamps_ms").alias("start_ms")).withColumn("artifact_path", artifact_path(F.col("media_id"), F.lit(extractor), F.lit(version), F.lit(config), F.col("start_ms")))
    mine = traces.where((F.col("trace_type") == "visual") & (F.col("extractor") == extractor) & (F.col("extractor_version") == version) & (F.col("configuration_hash") == config))
    out = want.join(mine.select("media_id", "start_ms", F.lit(True).alias("traced")).distinct(), ["media_id", "start_ms"], "left")
    out = out.join(artifacts.select("artifact_path", F.lit(True).alias("stored")).distinct(), "artifact_path", "left")
    return out.select("media_id", "start_ms", "artifact_path", F.when(F.col("traced") & F.col("stored"), "reuse").when(F.col("traced"), "repair").otherwise("create").alias("outcome"))


def import_traces(batch: DataFrame, traces: DataFrame) -> DataFrame:
    """Batch rows with an outcome; a repeat within the batch, or an identity that exists, is reused."""
    old = traces.select(*IDENTITY, F.lit(True).alias("__old")).distinct()
    w = Window.partitionBy(*IDENTITY).orderBy("content_text")
    out = batch.withColumn("__n", F.row_number().over(w)).join(old, IDENTITY, "left")
    return out.withColumn("outcome", F.when(F.col("__old").isNotNull() | (F.col("__n") > 1), "reused").otherwise("created")).drop("__old", "__n")


def refinement_plan(df: DataFrame) -> DataFrame:
    """Local frames around a coarse hit (coarse_ms) of a sampled video (interval_seconds, duration_seconds).

    Radius: half the interval in 2.5..30 s; step: a tenth in 0.5..2 s, raised so that at
    most 31 frames are taken; the frame nearest the coarse time is the coarse time. Rows
    that are no video, or have no duration, get NULL.
    """
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    ms = lambda x: F.bround(x * 1000, 0).cast("long")
    given = F.col("interval_seconds").cast("double")
    i = F.when(given > 0, given).otherwise(5.0)
    length = F.greatest(ms(F.coalesce(F.col("duration_seconds"), F.lit(0.0))), F.lit(0))
    ok = (F.col("media_kind") == "video") & (length > 0)
    out = df.withColumn("__c", F.least(F.greatest("coarse_ms", F.lit(0)), F.greatest(length - 1, F.lit(0))).cast("long"))
    c, radius = F.col("__c"), ms(clamp(i / 2, 2.5, 30.0))
    lo, hi = F.greatest(c - radius, F.lit(0)), F.least(length - 1, c + radius)
    out = out.withColumn("__lo", lo).withColumn("__hi", F.greatest(hi, F.col("__lo")))
    out = out.withColumn("__st", F.greatest(ms(clamp(i / 10, 0.5, 2.0)), F.ceil((F.col("__hi") - F.col("__lo")) / (MOST_LOCAL - 1))))
    out = out.withColumn("__grid", F.slice(F.sequence("__lo", "__hi", "__st"), 1, MOST_LOCAL))
    nearest = F.array_min(F.transform("__grid", lambda t: F.struct(F.abs(t - c).alias("d"), t.alias("t"))))["t"]
    out = out.withColumn("__near", nearest)
    frames = F.array_sort(F.array_distinct(F.transform("__grid", lambda t: F.when(t == F.col("__near"), c).otherwise(t))))
    return out.withColumn("frames_ms", F.when(ok, frames)).withColumn("step_ms", F.when(ok, F.col("__st"))).drop("__c", "__lo", "__hi", "__st", "__grid", "__near")


def media_inventory(media: DataFrame, q: str | None = None, kind: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """newest first; text is looked for in title or file name, in any case."""
    out = media
    if q:
        out = out.where(F.contains(F.lower("title"), F.lit(q.lower())) | F.contains(F.lower("filename"), F.lit(q.lower())))
    if kind:
        out = out.where(F.col("media_kind") == kind)
    if status:
        out = out.where(F.col("index_status") == status)
    return out.withColumn("checksum", F.substring("checksum_sha256", 1, 12)).orderBy(F.desc("created_at"), "media_id").limit(limit)


def inventory_summary(media: DataFrame) -> DataFrame:
    """Counts over the whole table, whatever the listing filters."""
    return media.agg(F.count("*").alias("total"), F.count_if(F.col("media_kind") == "video").alias("videos"), F.count_if(F.col("media_kind") == "image").alias("images"))


def validate_transcription(segments: DataFrame, group: str = "media_id", order: str = "position") -> DataFrame:
    """Q6: rows with their errors: times, order, blank text, confidence, language."""
    prev = F.lag("start_ms").over(Window.partitionBy(group).orderBy(order))
    rule = lambda when, text: F.when(F.coalesce(when, F.lit(False)), text)
    c = F.col("confidence")
    return segments.withColumn("errors", F.array_compact(F.array(
        rule(F.col("start_ms") < 0, "negative start"), rule(F.col("end_ms") < F.col("start_ms"), "end before start"), rule(F.trim(F.coalesce("text", F.lit(""))) == "", "blank text"),
        rule(prev > F.col("start_ms"), "out of order"), rule(c.isNotNull() & (F.isnan(c) | ~c.between(0, 1)), "confidence out of range"),
        rule(F.trim(F.coalesce("language", F.lit(""))) == "", "no language"))))
