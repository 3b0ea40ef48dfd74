"""Files dealt over tasks by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of files that make a task.
TASK_BYTES = 128 << 20
#: What opening a file costs, in bytes.
OPEN_BYTES = 1 << 20
#: Tasks at most, but for files that are alone in theirs: the driver keeps account of each.
MOST_TASKS = 1 << 13


def dealt_by_size(files: DataFrame, size: str = "length", task_bytes: int = TASK_BYTES, groups: int = 256) -> DataFrame:
    """``files`` (path, a column with the ``size`` in bytes, ...) in partitions of about ``task_bytes`` each; larger files are alone.

    Files are dealt into ``groups`` by a hash of their path, and in each, longest first, cut into
    tasks where running sums pass a multiple of ``task_bytes``; so no window holds all files,
    and tasks differ by one small file at most. Where that would be more than MOST_TASKS tasks, they get more bytes each.
    """
    cost = F.coalesce(size, F.lit(0)) + F.lit(OPEN_BYTES)
    total = files.agg(F.sum(cost).alias("b"), F.max(cost).alias("m")).first()
    if total["b"] is None:
        return files
    task_bytes = max(task_bytes, -(-int(total["b"]) // MOST_TASKS))
    wanted = max(1, -(-int(total["b"]) // task_bytes))
    groups = max(1, min(groups, wanted // 8))
    order = Window.partitionBy("__g").orderBy(F.desc(size), "path")
    numbered = files.withColumn("__g", F.pmod(F.xxhash64("path"), F.lit(groups))).withColumn("__s", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = numbered.withColumn("__t", F.when(cost >= task_bytes, F.concat(F.lit("alone "), "path")).otherwise(F.concat_ws(" ", "__g", F.floor(F.coalesce("__s", F.lit(0)) / task_bytes))))
    # each task's name to a partition of its own
    tasks = numbered.select("__t").distinct().withColumn("__p", F.row_number().over(Window.orderBy("__t")) - 1)
    count = tasks.count()
    placed = numbered.join(tasks, "__t")
    return placed.repartitionById(count, F.col("__p").cast("int")).drop("__g", "__s", "__t", "__p")
