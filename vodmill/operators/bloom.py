"""A Bloom filter of keys, two to four bytes a key, to drop rows before a shuffle that could find no partner in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits of the largest filter (128 MB, full with 67 million keys), bits for each key at least below that, and those that a key sets.
MOST_BITS, BITS_A_KEY, PROBES = 1 << 30, 16, 4


def passes(k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which of the longs ``k`` the filter ``t`` lets through."""
    last = len(t) * 64 - 1
    place, step, may = k & last, k >> 32 & last | 1, np.arange(len(k))
    # most fail at once: the places that follow are looked up for the rest alone
    for _ in range(PROBES):
        b = place[may]
        may = may[(t[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) > 0]
        place[may] = place[may] + step[may] & last
    out = np.zeros(len(k), bool)
    out[may] = True
    return out


def filled(keys: DataFrame, key: str = "key"):
    """The broadcast words of a filter of ``keys``.

    The filter is as long as its keys need, so that of other keys one in 400 passes at most, however many rows ask; only beyond
    MOST_BITS it lets more through, never fewer. It is built by tasks; the driver gets its words.
    """
    n = keys.count()
    bits = min(MOST_BITS, 1 << 16)
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    # a key's places: from one half of it, in steps of the other
    first, step = F.col(key).bitwiseAND(F.lit(bits - 1)), F.shiftright(F.col(key), 32).bitwiseAND(F.lit(bits - 1)).bitwiseOR(F.lit(1))
    places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*[(first + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)])).alias("b"))
    words = places.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def bloom(keys: DataFrame, key: str = "key"):
    """A function of a column of longs that tells which may be among ``keys``: all that are, and few others."""
    held = filled(keys, key)

    @F.pandas_udf(BooleanType())
    def told(column: pd.Series) -> pd.Series:
        return pd.Series(passes(column.to_numpy(dtype=np.int64), held.value))

    def may_have(column: Column) -> Column:
        return told(column)

    return may_have


def passing(rows: DataFrame, names: list[str], keys: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` that have a long among ``names`` that may be among ``keys``; those that can't be are NULL.

    Batches stream through. A function in a filter would keep a copy of each row in a queue for its answer,
    which goes to disk where memory is short, with all the rows of the task behind it.
    """
    held = filled(keys, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, some = dict(zip(b.schema.names, b.columns, strict=True)), np.zeros(b.num_rows, bool)
            for n in names:
                values = b.column(n).fill_null(0).to_numpy()
                may = passes(values, held.value) & b.column(n).is_valid().to_numpy(zero_copy_only=False)
                columns[n], some = pa.array(values, pa.int64(), mask=~may), some | may
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=b.schema.names).filter(pa.array(some))

    return rows.mapInArrow(run, rows.schema)
