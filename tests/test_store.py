"""The metrics store: pruned merges, rollups that follow a batch, repeated batches."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from vodmill.operators import analytics as A
from vodmill.streaming import store as S

DAILY = "date string, video_id string, content_type string, live_or_on_demand string, views long, watch_minutes double, average_view_duration double, likes long, subscribers_gained long, subscribers_lost long, estimated_revenue decimal(18,4), seq long"
POINTS = "video_id string, stream_position_seconds long, measured_at timestamp, concurrent_viewers decimal(18,4), peak_viewers long, seq long"


def daily_rows(rng, n, days, at):
    from decimal import Decimal

    return [(f"2026-08-{rng.choice(days):02d}", f"v{rng.randrange(9)}", "live", rng.choice(["live", "on_demand"]), rng.randrange(99), float(rng.randrange(50)), 1.0, rng.randrange(9), rng.randrange(5),
             rng.randrange(5), Decimal(rng.randrange(10_000)) / 100, rng.randrange(10**6) + at) for _ in range(n)]


def point_rows(rng, n):
    from decimal import Decimal

    return [(f"v{rng.randrange(5)}", 60 * rng.randrange(6), None, Decimal(rng.randrange(100)), rng.randrange(200), rng.randrange(10**6)) for _ in range(n)]


def files(root):
    return {f: (os.stat(f).st_mtime_ns, open(f, "rb").read()) for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def rolled(df):
    return sorted((r["video_id"], r["live_views"], r["replay_views"], r["total_views"], r["watch_minutes"], r["likes"], r["subscribers_gained"], round(r["revenue"], 4), round(r["average_concurrent"], 6), r["peak_concurrent"]) for r in df.collect())


@pytest.fixture
def kept(spark, tmp_path):
    return S.LivestreamStore(spark, str(tmp_path / "store"), ["seq"], buckets=4)


def test_rollups_follow_late_batches(spark, kept):
    rng = random.Random(1)
    batches = [daily_rows(rng, 60, range(1, 9), 0) for _ in range(4)]
    points = [point_rows(rng, 20) for _ in range(3)]
    for k, rows in enumerate(batches):
        kept.ingest_daily(spark.createDataFrame(rows, DAILY), k)
        if k < len(points):
            kept.ingest_series(spark.createDataFrame(points[k], POINTS), k)
    whole = A.upsert(None, spark.createDataFrame([r for b in batches for r in b], DAILY), A.DAILY_KEY, ["seq"])
    series = A.upsert(None, spark.createDataFrame([r for b in points for r in b], POINTS), A.SERIES_KEY, ["seq"])
    assert sorted(map(tuple, kept.daily().select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert rolled(kept.rollup()) == rolled(A.livestream_rollup(whole, series))


def test_a_peak_falls_with_its_point(spark, kept):
    row = lambda peak, seq: spark.createDataFrame([("v", 0, None, None, peak, seq), ("v", 60, None, None, 5, 1)], POINTS)
    kept.ingest_series(row(90, 1), 0)
    assert kept.rollup().first()["peak_concurrent"] == 90
    kept.ingest_series(row(7, 2), 1)
    assert kept.rollup().first()["peak_concurrent"] == 7


def test_untouched_days_keep_their_files(spark, kept, tmp_path):
    rng = random.Random(2)
    kept.ingest_daily(spark.createDataFrame(daily_rows(rng, 200, range(1, 21), 0), DAILY), 0)
    before = files(tmp_path / "store" / "daily")
    batch = spark.createDataFrame(daily_rows(rng, 30, (3, 4), 0), DAILY)
    held = kept._read("daily", ["d2026-08-03", "d2026-08-04"])
    read = {f.rsplit("/", 2)[1] for f in held.inputFiles()}
    assert {"folder=d2026-08-03", "folder=d2026-08-04"} == {x for x in read if "08-03" in x or "08-04" in x}
    assert "PartitionFilters: [isnotnull(folder" in (plan := held._jdf.queryExecution().toString()) or "PartitionFilters: [folder" in plan
    kept.ingest_daily(batch, 1)
    after = files(tmp_path / "store" / "daily")
    changed = {f.rsplit("/", 2)[1] for f in before.keys() ^ after.keys() | {f for f in before.keys() & after.keys() if before[f] != after[f]}}
    assert changed == {"folder=d2026-08-03", "folder=d2026-08-04"}


@pytest.mark.parametrize("broken", ["daily", "rollup"])
def test_a_repeated_batch_counts_once(spark, kept, monkeypatch, broken):
    """A batch fails just before or after a table is replaced and comes again, after the one before it was done."""
    rng = random.Random(3)
    one, two = daily_rows(rng, 80, range(1, 6), 0), daily_rows(rng, 80, range(1, 6), 0)
    kept.ingest_daily(spark.createDataFrame(one, DAILY), 0)
    publish = S.LivestreamStore._publish

    def failing(self, name, df, after):
        if name == broken and not after:
            raise RuntimeError("lost")
        publish(self, name, df)
        if name == broken and after:
            raise RuntimeError("lost")

    for after in (False, True):
        monkeypatch.setattr(S.LivestreamStore, "_publish", lambda self, name, df, after=after: failing(self, name, df, after))
        with pytest.raises(RuntimeError):
            kept.ingest_daily(spark.createDataFrame(two, DAILY), 1)
    monkeypatch.setattr(S.LivestreamStore, "_publish", publish)
    for _ in range(2):
        kept.ingest_daily(spark.createDataFrame(two, DAILY), 1)
    whole = A.upsert(None, spark.createDataFrame(one + two, DAILY), A.DAILY_KEY, ["seq"])
    none = spark.createDataFrame([], POINTS)
    assert rolled(kept.rollup()) == rolled(A.livestream_rollup(whole, none))


def test_empty_batches_and_empty_stores(spark, kept):
    kept.ingest_daily(spark.createDataFrame([], DAILY), 0)
    kept.ingest_series(spark.createDataFrame([], POINTS), 0)
    assert kept.rollup().count() == 0
    kept.ingest_daily(spark.createDataFrame(daily_rows(random.Random(4), 5, [1], 0), DAILY), 1)
    assert kept.rollup().agg(F.sum("total_views")).first()[0] == kept.daily().agg(F.sum("views")).first()[0]


def test_a_batch_is_exchanged_once_and_written_once(spark, kept, tmp_path):
    """Each kept row lies in one file below the store, and no second exchange brings rows to their folders."""
    import pyarrow.parquet as pq

    rng = random.Random(5)
    for k in range(3):
        kept.ingest_daily(spark.createDataFrame(daily_rows(rng, 80, range(1, 6), 0), DAILY), k)
        kept.ingest_series(spark.createDataFrame(point_rows(rng, 20), POINTS), k)
    rows = lambda c: sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{tmp_path}/store/**/*.parquet", recursive=True) if c in pq.read_schema(f).names)
    assert rows("average_view_duration") == kept.daily().count()
    assert rows("concurrent_viewers") == kept.series().count()
    new = spark.createDataFrame(daily_rows(rng, 80, range(1, 6), 0), DAILY).withColumn("folder", F.concat(F.lit("d"), "date"))
    plan = kept._merged("daily", new, A.DAILY_KEY, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
