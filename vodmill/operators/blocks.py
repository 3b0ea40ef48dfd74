"""Windows over the rows that follow, in blocks of equal size however the rows share their key.

Rows are sorted by key and order over all tasks and numbered by two prefix sums: a row's
place in its task, and the rows of the tasks before. Blocks of consecutive numbers replace
the key as the window's partition; the first rows of a block are copied to the one before,
so that its last rows see what follows them. A key with most of all rows is many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodmill.sources.shared import stored

#: Rows of a block.
BLOCK_ROWS = 1 << 16
_TASK_BITS = 33  # how monotonically_increasing_id numbers the rows of a task


def numbered(df: DataFrame, order: list[str], number: str = "__n") -> DataFrame:
    """``df`` with consecutive numbers in the order of ``order``; one exchange by ranges, a table in the shared folder.

    The counts of tasks that are broadcast are as many as tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("__id", _TASK_BITS)
    counts = rows.groupBy(task.alias("__task")).agg(F.count("*").alias("c"))
    before = counts.withColumn("__before", F.sum("c").over(Window.orderBy("__task")) - F.col("c")).drop("c")
    placed = rows.withColumn("__task", task).join(F.broadcast(before), "__task")
    return placed.withColumn(number, F.col("__before") + F.col("__id") - F.shiftleft("__task", _TASK_BITS)).drop("__task", "__before", "__id")


def following(df: DataFrame, key: str, order: list[str], values: list[str], rows: int, name: str) -> DataFrame:
    """``df`` with an array ``name``: ``values`` of each row and of the rows after it that have the same ``key``, ``rows`` in all at most."""
    if rows > BLOCK_ROWS:
        raise ValueError("a window can't be longer than a block")
    placed = numbered(df, [key, *order]).withColumn("__block", F.floor(F.col("__n") / BLOCK_ROWS)).withColumn("__copy", F.lit(False))
    halo = placed.where((F.col("__block") > 0) & (F.col("__n") % BLOCK_ROWS < rows - 1)).withColumn("__block", F.col("__block") - 1).withColumn("__copy", F.lit(True))
    window = Window.partitionBy("__block").orderBy("__n").rowsBetween(0, rows - 1)
    seen = F.collect_list(F.struct(F.col(key).alias("__key"), *values)).over(window)
    out = placed.unionByName(halo).withColumn("__seen", seen).where(~F.col("__copy"))
    same = F.filter("__seen", lambda x: x["__key"].eqNullSafe(F.col(key)))
    value: Column = F.transform(same, lambda x: x[values[0]]) if len(values) == 1 else F.transform(same, lambda x: F.struct(*[x[v].alias(v) for v in values]))
    return out.withColumn(name, value).drop("__n", "__block", "__copy", "__seen")
