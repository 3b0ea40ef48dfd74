"""A metrics store that batches are merged into, and livestream rollups that follow each batch.

Daily rows lie in folders by day (or month), time series in folders by a hash of the
video. A batch reads and writes anew only the folders that its rows fall into; the others
keep their files as they are. What it writes counts when it is whole, below the batch's
number, and a folder is read from the last number that has it: it is written once and
moved by one exchange. Rollups of videos are kept as sums: what a batch adds to
them is, for each of its keys, the new value minus the one it replaces, so the
rollups cost what the batch costs, not what the table holds.

A batch that is repeated after a failure takes what was written under its number; rollups are written aside
before they are replaced, and remember the last
batch that each video has seen, so no batch counts twice wherever the failure struck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vodmill.operators import analytics as A

#: Sums a rollup keeps of a video's daily rows.
SUMS = {
    "live_views": ("views", "live"), "replay_views": ("views", "on_demand"), "total_views": ("views", None), "watch_minutes": ("watch_minutes", None),
    "likes": ("likes", None), "subscribers_gained": ("subscribers_gained", None), "revenue": ("estimated_revenue", None),
}
#: The columns of a version of the daily rows that tell what its batch changes.
CHANGES = {n: f"change_{n}" for n in SUMS}
#: Tables whose folders are kept as their last batch wrote them, below its number; the others are small and replaced.
VERSIONED = ("daily", "series")
#: Pieces of folders that a task of a merge takes, about.
PIECES = 4


def _value(column: str, mode: str | None, row: str) -> Column:
    """What a row version gives to a sum; a version that isn't there gives 0."""
    value = F.coalesce(F.col(f"{row}.{column}"), F.lit(0))
    return value if mode is None else F.when(F.col("live_or_on_demand") == mode, value).otherwise(F.lit(0).cast("long"))


class LivestreamStore:
    """Daily metrics, time series and livestream rollups below ``root``, a folder that driver and executors share.

    ``span`` is the length of the date prefix that names a folder of daily rows: 10 for
    days, 7 for months. ``buckets`` is the number of folders of series and rollups. The driver
    holds the names of the folders that a batch touches: days of a calendar, or buckets.
    """

    def __init__(self, spark: SparkSession, root: str, order: list[str], series_order: list[str] | None = None, span: int = 10, buckets: int = 32):
        self.spark, self.root, self.span, self.buckets = spark, root.rstrip("/"), span, buckets
        self.order, self.series_order = order, series_order or ["seq"]

    # files ---------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _exists(self, path: str) -> bool:
        fs, place = self._fs(path)
        return fs.exists(place)

    def _delete(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)

    def _folders(self, name: str) -> dict[str, int]:
        """The number of the last batch that wrote each folder of a table kept by versions."""
        fs, place = self._fs(f"{self.root}/{name}")
        versions = sorted(int(v.getPath().getName()[2:]) for v in fs.listStatus(place)) if fs.exists(place) else []
        done = [n for n in versions if self._exists(f"{self.root}/{name}/v={n}/_SUCCESS")]
        names = lambda n: [f.getPath().getName() for f in fs.listStatus(self._fs(f"{self.root}/{name}/v={n}")[1])]
        return {f: n for n in done for f in names(n) if f.startswith("folder=")}

    def _read(self, name: str, folders: list | None = None) -> DataFrame | None:
        """A table, or the given folders of it; None before its first batch."""
        path = f"{self.root}/{name}"
        if name not in VERSIONED:
            if not self._exists(path):
                return None
            df = self.spark.read.parquet(path)
            return df if folders is None else df.where(F.col("folder").isin(folders))
        places = [f"{path}/v={n}/{f}" for f, n in sorted(self._folders(name).items())]
        if not places:
            return None
        df = self.spark.read.option("basePath", path).parquet(*places)
        df = df.drop("v", *CHANGES.values())
        return df if folders is None else df.where(F.col("folder").isin(folders))

    def _aside(self, name: str, number: int, make) -> DataFrame:
        """What ``make`` gives, written once under the batch's number; of a table kept by versions that is the version itself."""
        path = f"{self.root}/{name}/v={number}" if name in VERSIONED else f"{self.root}/aside/{name}-{number}"
        if not self._exists(f"{path}/_SUCCESS"):
            out = make().write.mode("overwrite").option("partitionOverwriteMode", "static")
            (out.partitionBy("folder") if name in VERSIONED else out).parquet(path)
        return self.spark.read.parquet(path)

    def _publish(self, name: str, new: DataFrame | int) -> None:
        """Replaces the folders that ``new`` has rows for; given a version's number, deletes the earlier ones of its folders."""
        if not isinstance(new, int):
            out = new.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder")
            out.parquet(f"{self.root}/{name}")
            return
        current = self._folders(name)
        fs, place = self._fs(f"{self.root}/{name}")
        for v in (int(x.getPath().getName()[2:]) for x in fs.listStatus(place)):
            if v < new and v not in current.values():
                self._delete(f"{self.root}/{name}/v={v}")
                continue
            for f, n in current.items():
                if v < n:
                    self._delete(f"{self.root}/{name}/v={v}/{f}")

    def _done(self, number: int, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/aside/{name}-{number - 1}")

    # merging -------------------------------------------------------------------------------------------------------

    def _merged(self, name: str, new: DataFrame, key: list[str], order: list[str], before: list[str] | None = None) -> DataFrame:
        """(folder, key, v, hit, old) of the touched folders: the winning version of each key, whether the batch has the key, the stored values of ``before``.

        One shuffle, by pieces of folders: a task holds whole pieces, so what it writes lies in few files.
        """
        folders = [r["folder"] for r in new.select("folder").distinct().collect()]
        held = self._read(name, folders)
        values = [c for c in new.columns if c not in key and c not in order and c != "folder"]
        rows = new.withColumn("hit", F.lit(1))
        if held is not None:
            rows = rows.unionByName(held.withColumn("hit", F.lit(0)), allowMissingColumns=True)
        pieces = -(-PIECES * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(folders)))
        rows = rows.withColumn("piece", F.pmod(F.hash(*key), F.lit(pieces))).repartition("folder", "piece")
        old = [F.max(F.when(F.col("hit") == 0, F.struct(*before))).alias("old")] if before else []
        out = rows.groupBy("folder", "piece", *key).agg(F.max(F.struct(*order, "hit", *values)).dropFields("hit").alias("v"), F.max("hit").alias("hit"), *old)
        return out.drop("piece")

    def _bucket(self, c: str = "video_id") -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int").alias("folder")

    def ingest_daily(self, batch: DataFrame, number: int) -> None:
        """Merges normalised daily rows: the last in ``order`` of each key wins, whatever batch it comes in.

        Then the batch's changes go to the rollups of its videos. A batch without rows changes nothing.
        """
        if batch.isEmpty():
            return
        new = batch.withColumn("folder", F.concat(F.lit("d"), F.substring("date", 1, self.span)))

        def merge() -> DataFrame:
            merged = self._merged("daily", new, A.DAILY_KEY, self.order, sorted({c for c, _ in SUMS.values()}))
            # what the batch changes stands beside its keys alone
            return merged.select("folder", *A.DAILY_KEY, "v.*", *[F.when(F.col("hit") == 1, _value(c, m, "v") - _value(c, m, "old")).alias(CHANGES[n]) for n, (c, m) in SUMS.items()])

        merged = self._aside("daily", number, merge)
        self._publish("daily", number)
        changes = merged.where(F.col(CHANGES["total_views"]).isNotNull()).groupBy("video_id").agg(*[F.sum(c).alias(n) for n, c in CHANGES.items()])
        changes = changes.select(self._bucket(), "video_id", *SUMS, F.lit(number).alias("seen"), F.lit(1).alias("change"))
        rolled = self._aside("rollup", number, lambda: self._rolled(changes, number))
        self._publish("rollup", rolled)
        self._done(number, "rollup")

    def _rolled(self, changes: DataFrame, number: int) -> DataFrame:
        held = self._read("rollup", [r["folder"] for r in changes.select("folder").distinct().collect()])
        rows = changes if held is None else changes.unionByName(held.withColumn("change", F.lit(0)))
        before = F.max(F.when(F.col("change") == 0, F.col("seen")))
        parts = [F.sum(F.when(F.col("change") == k, F.col(n))).alias(f"{n}_{k}") for n in SUMS for k in (0, 1)]
        out = rows.groupBy("folder", "video_id").agg(before.alias("before"), F.max("seen").alias("seen"), *parts)
        fresh = F.coalesce(F.col("before") < number, F.lit(True))
        total = lambda n: (F.coalesce(f"{n}_0", F.lit(0)) + F.when(fresh, F.coalesce(f"{n}_1", F.lit(0))).otherwise(0)).cast(rows.schema[n].dataType).alias(n)
        return out.select("folder", "video_id", *[total(n) for n in SUMS], "seen")

    def ingest_series(self, batch: DataFrame, number: int) -> None:
        """Merges time series points (video_id, stream_position_seconds, ...) and renews the concurrency of the batch's videos.

        A peak can fall when a point is replaced, so it is taken anew from the points of these videos, which lie in the touched folders.
        """
        if batch.isEmpty():
            return
        new = batch.withColumn("folder", self._bucket())
        merged = self._aside("series", number, lambda: self._merged("series", new, A.SERIES_KEY, self.series_order).select("folder", *A.SERIES_KEY, "v.*"))
        self._publish("series", number)
        touched = merged.groupBy("folder", "video_id").agg(
            F.avg("concurrent_viewers").cast("double").alias("average_concurrent"), F.max("peak_viewers").alias("peak_concurrent"))
        self._publish("concurrency", touched)

    # tables --------------------------------------------------------------------------------------------------------

    def daily(self, folders: list | None = None) -> DataFrame:
        """The merged daily rows with their order columns."""
        return self._read("daily", folders).drop("folder")

    def series(self) -> DataFrame:
        return self._read("series").drop("folder")

    def rollup(self) -> DataFrame:
        """A7 over all batches so far, from the kept sums."""
        a, b = self._read("rollup"), self._read("concurrency")
        if a is None:
            a = self.spark.createDataFrame([], "folder int, seen int, video_id string, " + ", ".join(f"{n} {'double' if n in ('watch_minutes', 'revenue') else 'long'}" for n in SUMS))
        if b is None:
            b = self.spark.createDataFrame([], "folder int, video_id string, average_concurrent double, peak_concurrent long")
        out = a.drop("folder", "seen").join(b.drop("folder"), "video_id", "full").withColumn("revenue", F.col("revenue").cast("double"))
        return out.select("video_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "video_id"])
