"""Incremental ingestion of daily metrics and livestream time series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vodmill.operators import analytics as A

from .store import LivestreamStore

LATE_DAYS = 3


def incremental_window(syncs: DataFrame, backfill_start: str, today: str) -> DataFrame:
    """ST1: (start, end, no_op): from three days before the last successful end, at the earliest the backfill start.

    ``syncs``: status, last_successful_date. Without a completed sync the window starts at the backfill start.
    """
    last = syncs.where("status = 'complete'").agg(F.max(F.col("last_successful_date").cast("date")).alias("d"))
    start = F.greatest(F.lit(backfill_start).cast("date"), F.date_sub("d", LATE_DAYS))
    out = last.select(F.date_format(start, "yyyy-MM-dd").alias("start"), F.lit(today).alias("end"))
    return out.withColumn("no_op", F.col("start") > F.col("end"))


def _started(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_daily(rows: DataFrame, start: str, store: LivestreamStore, checkpoint: str) -> StreamingQuery:
    """ST2: upserts micro-batches of report rows; the last write per key wins, days before ``start`` are ignored.

    Last is what the store's order columns say, within a batch and between batches, so neither
    the order of files nor their number per batch changes the result. The rollups of the
    batch's videos follow in the same step; a repeated batch changes nothing.
    """
    return _started(rows, lambda batch, number: store.ingest_daily(A.normalize_daily(batch).where(F.col("date") >= start), number), checkpoint)


def ingest_series(rows: DataFrame, starts: DataFrame, store: LivestreamStore, checkpoint: str) -> StreamingQuery:
    """ST2: upserts micro-batches of time series points and renews the concurrency of their videos."""
    return _started(rows, lambda batch, number: store.ingest_series(A.timeseries(batch, starts), number), checkpoint)
