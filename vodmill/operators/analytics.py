"""Channel analytics: normalised metrics, upserts, rollups, comparisons and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodmill.functions import metrics as M

DAILY_KEY = ["date", "video_id", "content_type", "live_or_on_demand"]
MEASURES = ["views", "watch_minutes", "average_view_duration", "likes", "subscribers_gained", "subscribers_lost", "estimated_revenue"]
#: Order of the content types in reports.
TYPE_ORDER = ["short", "live", "vod", "unknown"]
SERIES_KEY = ["video_id", "stream_position_seconds"]


def normalize_daily(rows: DataFrame) -> DataFrame:
    """Report rows to daily metrics; missing measures become 0. Further columns (sequence) pass through."""
    used = {"day", "video", "creatorContentType", "liveOrOnDemand", "views", "estimatedMinutesWatched", "averageViewDuration", "likes",
            "subscribersGained", "subscribersLost", "estimatedRevenue"}
    number = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    return rows.select(
        F.col("day").alias("date"), F.col("video").alias("video_id"), M.content_type(F.col("creatorContentType"), F.lit(0), F.lit(False)).alias("content_type"),
        M.live_or_on_demand(F.col("liveOrOnDemand")).alias("live_or_on_demand"), number("views", "long").alias("views"),
        number("estimatedMinutesWatched", "double").alias("watch_minutes"), number("averageViewDuration", "double").alias("average_view_duration"),
        number("likes", "long").alias("likes"), number("subscribersGained", "long").alias("subscribers_gained"),
        number("subscribersLost", "long").alias("subscribers_lost"), number("estimatedRevenue", "decimal(18,4)").alias("estimated_revenue"),
        *[c for c in rows.columns if c not in used],
    )


def upsert(target: DataFrame | None, batch: DataFrame, key: list[str], order: list[str], across: bool = False) -> DataFrame:
    """``target`` with the rows of ``batch`` put in by ``key``; the batch's last row in ``order`` wins.

    With ``across`` a row of ``target`` that is later in ``order`` stays, so that the result does
    not depend on how rows are dealt into batches; the order columns are kept in the table for it.

    One shuffle by key; the map side keeps a row per key and task. The result is a new
    version: write it elsewhere than ``target`` is read from.
    """
    rows = batch.withColumn("__new", F.lit(1))
    if target is not None:
        rows = rows.unionByName(target.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    values = [c for c in rows.columns if c not in key and c != "__new"]
    best = F.max_by(F.struct(*values), F.struct(*([*order, "__new"] if across else ["__new", *order]))).alias("v")
    return rows.groupBy(*key).agg(best).select(*key, "v.*")


def totals() -> list[Column]:
    """A1: the summary measures of any group of daily rows, 0 where there are none."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    revenue, views = s("estimated_revenue").cast("double"), s("views")
    return [
        revenue.alias("revenue"), views.alias("views"), s("watch_minutes").alias("watch_minutes"), (s("watch_minutes") / 60).alias("watch_hours"),
        s("likes").alias("likes"), s("subscribers_gained").alias("subscribers_gained"), s("subscribers_lost").alias("subscribers_lost"),
        (s("subscribers_gained") - s("subscribers_lost")).alias("subscriber_net"), M.rpm(revenue, views).alias("rpm"),
    ]


def between(daily: DataFrame, start: str, end: str) -> DataFrame:
    """both ends count; days compare as ISO strings."""
    return daily.where(F.col("date").between(start, end))


def summarize(daily: DataFrame) -> DataFrame:
    return daily.agg(*totals())


def daily_chart(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(*totals()).orderBy("date")


def weighted_duration() -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col("average_view_duration") * F.col("views")), F.sum("views")), F.lit(0.0)).alias("average_view_duration")


def content_type_breakdown(daily: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in TYPE_ORDER]), F.col("content_type"))
    return daily.groupBy("content_type").agg(*totals(), weighted_duration()).withColumn("position", rank.cast("int")).orderBy("position")


def overview(daily: DataFrame, start: str, end: str) -> DataFrame:
    """A4: totals, a row per day and a row per type in one pass and one shuffle."""
    return between(daily, start, end).groupingSets([[], ["date"], ["content_type"]], "date", "content_type").agg(
        F.grouping_id().alias("g"), *totals()).withColumn(
        "part", F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "day").otherwise("type")).drop("g")


def previous_period(start: str) -> tuple[Column, Column]:
    """First day of the month before-or-at the day before ``start``, and that day."""
    last = F.date_sub(F.lit(start).cast("date"), 1)
    return F.trunc(last, "month"), last


def period_comparison(daily: DataFrame, start: str, end: str) -> DataFrame:
    """A5: both periods from one scan, and the percentage changes."""
    lo, hi = previous_period(start)
    day = F.col("date").cast("date")
    now = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    before = day.between(lo, hi)
    names = ["views", "watch_minutes", "likes", "subscribers_gained", "subscribers_lost", "estimated_revenue"]
    sums = [F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).cast("double").alias(f"{p}_{c}") for c in names for p, w in (("current", now), ("previous", before))]
    out = daily.where(F.col("date") <= end).agg(*sums)
    return out.select("*", *[M.percent_delta(F.col(f"current_{c}"), F.col(f"previous_{c}")).alias(f"{c}_delta") for c in names])


def pace_forecast(daily: DataFrame, today: str) -> DataFrame:
    """Month-to-date run rate and 7- and 28-day pace of revenue."""
    t = F.lit(today).cast("date")
    day = F.col("date").cast("date")
    within = lambda lo: day.between(lo, t)
    rev = F.col("estimated_revenue")
    out = daily.where(F.col("date") <= today).agg(
        F.coalesce(F.sum(F.when(within(F.trunc(t, "month")), rev)), F.lit(0)).cast("double").alias("mtd"),
        F.sum(F.when(within(F.date_sub(t, 6)), rev)).cast("double").alias("w7"), F.sum(F.when(within(F.date_sub(t, 27)), rev)).cast("double").alias("w28"))
    length, gone = F.dayofmonth(F.last_day(t)), F.dayofmonth(t)
    pace = lambda c, n: F.col("mtd") + F.col(c) / n * (length - gone)
    return out.select(
        "mtd", F.when(F.col("mtd") != 0, F.col("mtd") / gone * length).alias("run_rate"), pace("w7", 7).alias("pace_7"), pace("w28", 28).alias("pace_28"))


def livestream_rollup(daily: DataFrame, series: DataFrame) -> DataFrame:
    """Per video, daily sums by mode and the concurrency of its time series."""
    v = lambda mode: F.coalesce(F.sum(F.when(F.col("live_or_on_demand") == mode, F.col("views"))), F.lit(0))
    a = daily.groupBy("video_id").agg(
        v("live").alias("live_views"), v("on_demand").alias("replay_views"), F.sum("views").alias("total_views"), F.sum("watch_minutes").alias("watch_minutes"),
        F.sum("likes").alias("likes"), F.sum("subscribers_gained").alias("subscribers_gained"), F.sum("estimated_revenue").cast("double").alias("revenue"))
    b = series.groupBy("video_id").agg(F.avg("concurrent_viewers").cast("double").alias("average_concurrent"), F.max("peak_viewers").alias("peak_concurrent"))
    out = a.join(b, "video_id", "full")
    return out.select("video_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "video_id"])


def livestreams_in_range(videos: DataFrame, start: str, end: str) -> DataFrame:
    """as strings, so a time with a zone mark at the end day's last second is outside."""
    return videos.where((F.col("content_type") == "live") & F.col("published_at").between(start, end + "T23:59:59"))


def livestream_summaries(videos: DataFrame, rollup: DataFrame, start: str, end: str) -> DataFrame:
    """Rollups of the livestreams in range, newest first."""
    chosen = livestreams_in_range(videos, start, end)
    joined = chosen.join(rollup, "video_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in rollup.columns if c != "video_id"]
    return joined.select("video_id", "title", "published_at", "duration_seconds", *zero).orderBy(F.desc("published_at"), "video_id")


def livestream_timeline(series: DataFrame) -> DataFrame:
    """Each livestream's points numbered by position; no stream is gathered into one row."""
    w = Window.partitionBy("video_id").orderBy("stream_position_seconds")
    return series.withColumn("point", F.row_number().over(w))


def timeseries(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """measured_at = start + position (NULL without a start); concurrency = average, else peak."""
    out = rows.join(starts, rows.video == starts.video_id, "left")
    avg, peak = F.col("averageConcurrentViewers"), F.col("peakConcurrentViewers")
    return out.select(
        F.col("video").alias("video_id"), F.col("livestreamPosition").alias("stream_position_seconds"),
        F.timestamp_seconds(F.unix_seconds("actual_start") + F.col("livestreamPosition")).alias("measured_at"),
        F.when(F.coalesce(avg, F.lit(0)) != 0, avg).otherwise(F.coalesce(peak, F.lit(0))).cast("decimal(18,4)").alias("concurrent_viewers"),
        F.coalesce(peak, F.lit(0)).alias("peak_viewers"), *[c for c in rows.columns if c.startswith("seq")])


def link_streams(videos: DataFrame, streams: DataFrame) -> DataFrame:
    """Videos with the id of the stream that has the same source id; an old link stays otherwise."""
    s = streams.where("platform = 'youtube'").select(F.col("source_video_id").alias("video_id"), F.col("stream_id").alias("__found"))
    old = F.col("stream_id") if "stream_id" in videos.columns else F.lit(None)
    out = videos.join(s, "video_id", "left").withColumn("stream_id", F.coalesce("__found", old))
    return out.drop("__found")


def with_stubs(daily: DataFrame, videos: DataFrame) -> DataFrame:
    """The known videos and a stub row for every other video of the metrics."""
    missing = daily.select("video_id").join(videos, "video_id", "left_anti").distinct()
    return videos.unionByName(missing, allowMissingColumns=True)


def video_attributes(rows: DataFrame, order: str) -> DataFrame:
    """Per video the first row's duration, the last non-blank title and the last known type."""
    return rows.groupBy("video_id").agg(
        F.min_by("duration_seconds", order).alias("duration_seconds"),
        F.max_by("title", F.when(F.trim("title") != "", F.col(order))).alias("title"),
        F.max_by("content_type", F.when(F.col("content_type") != "unknown", F.col(order))).alias("content_type"),
    ).select("video_id", "duration_seconds", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content_type", F.lit("unknown")).alias("content_type"))


def trailing_revenue(daily: DataFrame, channel: str) -> DataFrame:
    """Revenue of the 7 and 28 days up to every day, per channel; days are aggregated first."""
    days = daily.groupBy(channel, "date").agg(F.sum("estimated_revenue").alias("revenue"))
    days = days.withColumn("n", F.datediff(F.col("date").cast("date"), F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(channel).orderBy("n")
    return days.select(
        channel, "date", F.col("revenue").cast("double").alias("revenue"), F.sum("revenue").over(w.rangeBetween(-6, 0)).cast("double").alias("revenue_7"),
        F.sum("revenue").over(w.rangeBetween(-27, 0)).cast("double").alias("revenue_28"))


def route_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T4: (daily rows, timeseries rows, video attributes) of one normalised CSV.

    A row with a position, or of type livestream_timeseries, is never a daily row.
    """
    col = lambda *names: M.first_value(*[F.col(n) for n in names if n in rows.columns]) if any(n in rows.columns for n in names) else F.lit("")
    pos = M.stream_position(*[F.col(n) for n in ("livestream_position", "stream_position", "position", "elapsed_time") if n in rows.columns] or [F.lit("")])
    kind = F.lower(col("row_type", "type"))
    base = rows.select(
        M.normalize_date(col("date", "day")).alias("date"), col("video_id", "video", "content").alias("video_id"), col("video_title", "title").alias("title"),
        M.content_type(col("content_type", "creatorcontenttype"), M.duration_to_seconds(col("duration")), F.lit(False)).alias("content_type"),
        M.live_or_on_demand(col("live_or_on_demand")).alias("live_or_on_demand"), M.lenient_long(M.csv_number(col("views"))).alias("views"),
        M.watch_minutes(col("watch_time_minutes"), col("watch_time_hours"), col("watch_time")).alias("watch_minutes"),
        M.duration_to_seconds(col("average_view_duration")).cast("double").alias("average_view_duration"), M.lenient_long(M.csv_number(col("likes"))).alias("likes"),
        M.lenient_long(M.csv_number(col("subscribers_gained"))).alias("subscribers_gained"), M.lenient_long(M.csv_number(col("subscribers_lost"))).alias("subscribers_lost"),
        M.csv_number(col("estimated_revenue")).cast("decimal(18,4)").alias("estimated_revenue"), pos.alias("stream_position_seconds"), kind.alias("kind"),
        M.csv_number(col("average_concurrent_viewers")).alias("concurrent_viewers"), M.lenient_long(M.csv_number(col("peak_concurrent_viewers"))).alias("peak_viewers"),
        M.duration_to_seconds(col("duration")).alias("duration_seconds"), "seq",
    ).where("video_id != ''")
    timed = F.col("stream_position_seconds").isNotNull() | (F.col("kind") == "livestream_timeseries")
    daily = base.where(~timed & (F.col("date") != "")).select(*DAILY_KEY, *MEASURES, "seq")
    series = base.where(F.col("stream_position_seconds").isNotNull()).select(*SERIES_KEY, "concurrent_viewers", "peak_viewers", "seq")
    return daily, series, video_attributes(base, "seq")
