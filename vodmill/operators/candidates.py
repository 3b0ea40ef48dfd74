"""Clip candidates: filters, ranking, facets, duplicate checks, validation and reanalysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodmill.functions import candidates as C

DUPLICATE_KEY = ["stream_id", "title", "start_seconds", "end_seconds"]


def filter_candidates(cands: DataFrame, runs: DataFrame | None = None, pillar: str | None = None, tag: str | None = None, method: str | None = None, status: str | None = None) -> DataFrame:
    """without a status, archived rows are left out; the tag is normalised before the membership test."""
    out = cands.where(F.col("review_status") == status) if status else cands.where("review_status != 'archived'")
    if pillar:
        out = out.where(F.col("primary_pillar") == pillar)
    if tag:
        out = out.where(F.array_contains("tags", F.element_at(C.normalize_tags(F.array(F.lit(tag))), 1)))
    if method:
        out = out.join(runs.where(F.col("model") == method).select("analysis_run_id"), "analysis_run_id", "left_semi")
    return out


def visible_clips(cands: DataFrame, include_check: bool = True) -> DataFrame:
    out = cands.where("review_status != 'archived'")
    return out if include_check else out.where("review_status != 'needs_verification'")


def stream_batch(streams: DataFrame, offset: int, limit: int) -> DataFrame:
    """a slice of all streams, newest first."""
    return streams.orderBy(F.desc("published_at"), "stream_id").offset(offset).limit(limit)


def pending_streams(streams: DataFrame, limit: int | None = None) -> DataFrame:
    out = streams.where(F.col("processing_status").isin("queued", "failed")).orderBy(F.desc("published_at"), "stream_id")
    return out.limit(limit) if limit else out


def favourites(cands: DataFrame, which: str = "all", by: str = "weighted_score", descending: bool = True, order: str = "candidate_window_id") -> DataFrame:
    """all, favourites or the others, ties in original order."""
    out = cands if which == "all" else cands.where(F.col("is_favorite") == F.lit(which == "favourites"))
    key = F.col(by).desc() if descending else F.col(by).asc()
    return out.orderBy(key, order)


def enrich(cands: DataFrame, streams: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Candidates with their stream and run; without ``runs`` only with their stream, which saves an exchange of the candidates."""
    s = streams.select("stream_id", F.col("title").alias("stream_title"), "published_at", "source_video_id")
    out = cands.join(s, "stream_id")
    return out if runs is None else out.join(runs, "analysis_run_id", "left")


def skip_duplicates(batch: DataFrame, existing: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows skipped). With ``model`` only unarchived rows of that model count as present."""
    if model is not None:
        existing = existing.where((F.col("model") == model) & (F.col("review_status") != "archived"))
    keys = existing.select(*DUPLICATE_KEY).distinct()
    return batch.join(keys, DUPLICATE_KEY, "left_anti"), batch.join(keys, DUPLICATE_KEY, "left_semi")


def rank_in_run(rows: DataFrame, order: str = "position") -> DataFrame:
    """1-based response order per run, before duplicates are skipped."""
    return rows.withColumn("candidate_rank", F.row_number().over(Window.partitionBy("analysis_run_id").orderBy(order)))


def rank_candidates(cands: DataFrame, limit: int | None = None) -> DataFrame:
    """Best score first, ties by id; limit 0 or None is all."""
    out = cands.orderBy(F.desc("weighted_score"), "candidate_window_id")
    return out.limit(limit) if limit else out


def clip_feed(cands: DataFrame, streams: DataFrame, limit: int = 200) -> DataFrame:
    """K1: newest streams first, then best score; at most 200 rows."""
    s = streams.select("stream_id", "published_at")
    return visible_clips(cands).join(s, "stream_id").orderBy(F.desc("published_at"), F.desc("weighted_score"), "candidate_window_id").limit(min(limit, 200))


def listing(cands: DataFrame, streams: DataFrame, sort: Column | None = None) -> DataFrame:
    """K2: newest first and then lowest score first, below the chosen sort column (highest first)."""
    s = streams.select("stream_id", "published_at")
    keys = [F.desc("published_at"), F.asc("weighted_score"), F.asc("candidate_window_id")]
    return cands.join(s, "stream_id").orderBy(*([sort.desc()] if sort is not None else []), *keys)


def pipeline_counts(streams: DataFrame, cands: DataFrame) -> DataFrame:
    """(what, n): streams per status, candidates in total and by the two reviewed states."""
    a = streams.groupBy(F.concat(F.lit("stream:"), "processing_status").alias("what")).agg(F.count("*").alias("n"))
    b = cands.agg(F.count("*").alias("total"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_if(F.col("review_status") == "needs_verification").alias("needs_verification"))
    b = b.unpivot([], ["total", "approved", "needs_verification"], "what", "n").select(F.concat(F.lit("candidate:"), "what").alias("what"), "n")
    return a.unionByName(b)


def facets(cands: DataFrame, runs: DataFrame) -> DataFrame:
    """A10: distinct tags and distinct non-empty models, sorted."""
    tags = cands.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value")).distinct()
    models = runs.where("model != ''").select(F.lit("model").alias("facet"), F.col("model").alias("value")).distinct()
    return tags.unionByName(models).orderBy("facet", "value")


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def new_clip_ids(before: DataFrame, after: DataFrame, old_batch: DataFrame, key: str = "candidate_window_id") -> DataFrame:
    """Ids in ``after`` that are not in ``before``; the old batch if there are none."""
    new = after.select(key).join(before.select(key), key, "left_anti").distinct()
    none = new.limit(1).agg(F.count("*").alias("c")).where("c = 0")
    return new.unionByName(old_batch.select(key).distinct().join(F.broadcast(none), F.lit(True), "left_semi"))


def expected_set_check(active: DataFrame, expected: DataFrame, group: str = "stream_id", key: str = "candidate_window_id") -> DataFrame:
    """Per group whether the id sets are equal, and what is missing or more."""
    a = active.groupBy(group).agg(F.sort_array(F.collect_set(key)).alias("active"))
    e = expected.groupBy(group).agg(F.sort_array(F.collect_set(key)).alias("expected"))
    none = F.array().cast("array<string>")
    out = a.join(e, group, "full").select(group, F.coalesce("active", none).alias("active"), F.coalesce("expected", none).alias("expected"))
    return out.select(group, (F.col("active") == F.col("expected")).alias("same"), F.array_except("expected", "active").alias("missing"), F.array_except("active", "expected").alias("unexpected"))


def import_lanes(*lanes: DataFrame) -> DataFrame:
    """One candidate table of the import lanes; absent columns are NULL."""
    out = lanes[0]
    for x in lanes[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def validate(rows: DataFrame, pillars: list[str], scores: list[str], response: str = "response_id") -> DataFrame:
    """Q1: rows with ``errors`` (sorted) and ``quarantined``: any error, or not 1 to 5 candidates, holds back the whole response."""
    bad = lambda when, text: F.when(F.coalesce(when, F.lit(True)), F.lit(text))
    s, e, d = F.col("start_seconds"), F.col("end_seconds"), F.col("duration_seconds")
    rules = [
        bad(F.coalesce(F.col("title"), F.lit("")) == "", "title is required"), bad(s < 0, "start_seconds must not be negative"),
        bad(e <= s, "end_seconds must be after start_seconds"), bad(d != e - s, "duration_seconds must equal end minus start"),
        bad(C.timestamp_to_seconds(F.col("start_timestamp")) != s, "start_timestamp does not match start_seconds"),
        bad(C.timestamp_to_seconds(F.col("end_timestamp")) != e, "end_timestamp does not match end_seconds"),
        bad(~F.col("primary_pillar").isin(*pillars), "unknown pillar"),
        bad(F.exists("transcript_evidence", lambda x: ~x["seconds"].between(s, e)), "evidence outside the window"),
        bad(F.exists("transcript_evidence", lambda x: C.timestamp_to_seconds(x["timestamp"]) != x["seconds"]), "evidence timestamp does not match"),
        *[bad(~F.col(f"scores.{k}").between(0, 100), f"score {k} out of range") for k in scores],
    ]
    out = rows.withColumn("errors", F.sort_array(F.array_compact(F.array(*rules))))
    w = Window.partitionBy(response)
    n = F.count("*").over(w)
    return out.withColumn("quarantined", (F.max(F.size("errors") > 0).over(w)) | (n > 5))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row per key; the map side keeps one row per key and task."""
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, "v.*")


def latest_transcript(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Newest by updated_at, created_at and id; with ``stored`` (raw_location) rows whose file exists come first."""
    if stored is None:
        return latest(rows, "stream_id", "updated_at", "created_at", "stream_transcript_id")
    has = rows.join(stored.select("raw_location").distinct().withColumn("stored", F.lit(1)), "raw_location", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return latest(has, "stream_id", "stored", "updated_at", "created_at", "stream_transcript_id")


def has_content(livestreams: DataFrame, *others: DataFrame, key: str = "stream_id") -> DataFrame:
    """Whether any of the other tables has a row of the stream."""
    keys = others[0].select(key)
    for o in others[1:]:
        keys = keys.unionByName(o.select(key))
    return livestreams.join(keys.distinct().withColumn("__has", F.lit(True)), key, "left").withColumn("has_content", F.coalesce("__has", F.lit(False))).drop("__has")


def reanalysis_plan(active: DataFrame, runs: DataFrame, expected: DataFrame, assets: DataFrame) -> DataFrame:
    """Q7: per stream the reasons against replacing its candidates; safe without one.

    ``active``: unarchived candidates with is_favorite, review_status, processing_status, reviewer_notes.
    """
    linked = assets.select("candidate_window_id").distinct().withColumn("linked", F.lit(True))
    rows = active.join(linked, "candidate_window_id", "left")
    own = F.array_compact(F.array(
        F.when(F.col("is_favorite"), "favourite"), F.when(F.col("review_status") != "pending_review", "reviewed"),
        F.when(F.col("processing_status") != "complete", "not complete"), F.when(F.trim(F.coalesce("reviewer_notes", F.lit(""))) != "", "has notes"),
        F.when(F.coalesce("linked", F.lit(False)), "has assets")))
    per = rows.select("stream_id", "candidate_window_id", F.transform(own, lambda b: F.concat(F.col("candidate_window_id"), F.lit(": "), b)).alias("b"))
    blockers = per.groupBy("stream_id").agg(F.sort_array(F.flatten(F.collect_list("b"))).alias("row_blockers"), F.count("*").alias("n"))
    check = expected_set_check(active, expected).select("stream_id", "same")
    busy = runs.where("status = 'processing'").select("stream_id").distinct().withColumn("busy", F.lit(True))
    out = check.join(blockers, "stream_id", "left").join(busy, "stream_id", "left")
    general = F.array_compact(F.array(
        F.when(F.coalesce("n", F.lit(0)) == 0, "no active candidates"), F.when(F.coalesce("busy", F.lit(False)), "a run is processing"), F.when(~F.col("same"), "candidate set changed")))
    all_ = F.concat(general, F.coalesce("row_blockers", F.array().cast("array<string>")))
    return out.select("stream_id", all_.alias("blockers"), (F.size(all_) == 0).alias("safe"))


def supersede(cands: DataFrame, plan: DataFrame, captured: DataFrame, replacements: DataFrame, run_id: str, reason: str) -> DataFrame:
    """Q8: in safe streams the captured rows are archived with a history entry; elsewhere the replacements are archived."""
    safe = plan.select("stream_id", "safe")
    old = captured.select("candidate_window_id").distinct().withColumn("__old", F.lit(True))
    new = replacements.select("candidate_window_id").distinct().withColumn("__new", F.lit(True))
    out = cands.join(safe, "stream_id", "left").join(old, "candidate_window_id", "left").join(new, "candidate_window_id", "left")
    ok = F.coalesce("safe", F.lit(False))
    goes = ok & F.coalesce("__old", F.lit(False))
    entry = F.array(F.struct(F.lit(run_id).alias("replacement_run"), F.lit(reason).alias("reason")))
    history = F.when(goes, F.concat(F.col("history"), entry)).otherwise(F.col("history"))
    return out.withColumn("history", history).withColumn("review_status", F.when(goes | (~ok & F.coalesce("__new", F.lit(False))), "archived").otherwise(F.col("review_status"))).drop("safe", "__old", "__new")
