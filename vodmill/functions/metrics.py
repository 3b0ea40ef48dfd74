"""Column functions for analytics exports: lenient numbers, dates, durations, types.

Missing values are empty strings or 0, as in the exports; nothing raises on bad input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted date layouts, in order.
DATE_LAYOUTS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMMM d, yyyy": r"^[A-Za-z]{4,} \d{1,2}, \d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
}
DIGITS = r"^[0-9]+$"


def first_value(*cols: Column) -> Column:
    """The first value that is neither NULL nor '', then trimmed; '' if there is none."""
    return F.coalesce(F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])), F.lit(""))


def csv_number(c: Column) -> Column:
    """'$1,234.5', '12%' and '(3)' as doubles; anything else is 0."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[$,%]", ""))
    signed = F.when(bare.startswith("(") & bare.endswith(")"), F.concat(F.lit("-"), F.regexp_replace(bare, r"^\(|\)$", ""))).otherwise(bare)
    return F.coalesce(signed.try_cast("double"), F.lit(0.0))


def normalize_date(c: Column) -> Column:
    """The day as 'yyyy-MM-dd', from any accepted layout or an ISO date-time; '' if none fits."""
    s = F.trim(F.coalesce(c, F.lit("")))
    # a failing parse is the costly one: each layout is tried where its shape fits, so a row is parsed once
    tries = [F.when(s.rlike(shape), F.try_to_date(s, layout)) for layout, shape in DATE_LAYOUTS.items()]
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.substring(s, 1, 10).try_cast("date"))
    return F.coalesce(F.date_format(F.coalesce(*tries, iso), "yyyy-MM-dd"), F.lit(""))


def duration_to_seconds(c: Column) -> Column:
    """Digits, MM:SS or HH:MM:SS (decimals cut off per part) as whole seconds; else 0."""
    s = F.trim(F.coalesce(c, F.lit("")))
    parts = F.transform(F.split(s, ":"), lambda p: F.floor(p.try_cast("double")).cast("long"))
    clock = F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t * 60 + p)
    return F.when(s.rlike(DIGITS), s.try_cast("long")).when(
        s.rlike(r"^[0-9]+(\.[0-9]+)?(:[0-9]+(\.[0-9]+)?){1,2}$"), clock).otherwise(F.lit(0).cast("long"))


def stream_position(*cols: Column) -> Column:
    """Seconds into a stream; NULL for blank or unreadable, while '0', '00:00' and '00:00:00' are 0."""
    s = first_value(*cols)
    n = duration_to_seconds(s)
    return F.when(s.isin("0", "00:00", "00:00:00"), F.lit(0).cast("long")).when(n != 0, n)


def watch_minutes(minutes: Column, hours: Column, plain: Column) -> Column:
    m, h = csv_number(minutes), csv_number(hours)
    return F.when(m != 0, m).when(h != 0, h * 60).otherwise(csv_number(plain))


def content_type(label: Column, duration: Column, is_live: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    d = F.coalesce(duration, F.lit(0))
    return (
        F.when(F.contains(low, F.lit("short")), "short")
        .when(F.coalesce(is_live, F.lit(False)) | F.contains(low, F.lit("live")), "live")
        .when(low.isin("video_on_demand", "video on demand", "vod"), "vod")
        .when((d > 0) & (d <= 60), "short").when(d > 0, "vod").otherwise("unknown")
    )


def live_or_on_demand(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), " ", "_")
    return F.when(low.isin("live", "subscribed_live"), "live").when(
        low.isin("on_demand", "ondemand", "replay"), "on_demand").otherwise("unknown")


def lenient_long(c: Column) -> Column:
    """A number cut to whole, 0 for NULL or unreadable values."""
    x = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < 9e18), x).cast("long"), F.lit(0).cast("long"))


def rpm(revenue: Column, views: Column) -> Column:
    return F.when(views != 0, revenue / views * 1000).otherwise(F.lit(0.0))


def percent_delta(current: Column, previous: Column) -> Column:
    return F.when(previous.isNotNull() & (previous != 0), (current - previous) / previous * 100)


def iso8601_duration(c: Column) -> Column:
    """PT[nH][nM][nS] as seconds; anything else is 0."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda i: F.coalesce(F.regexp_extract(c, pattern, i).try_cast("long"), F.lit(0))
    return F.when(c.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(F.lit(0)).cast("long")


def parse_datetime(c: Column) -> Column:
    """ISO date-time; a value without a zone is taken in the session's zone (UTC); NULL if unreadable."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(c))
