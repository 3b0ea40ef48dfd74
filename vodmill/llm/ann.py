"""Operator 3: approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate each unit vector; its
cell in a table is the signed axis it is nearest to. Every row is indexed in every
table. A query probes the cells whose axes it is nearest to over all tables: it may take
several of a table and none of another. The rows of these cells are its candidates, each
compared once, by the exact distance in double precision on the original vectors.

Rows are dealt into parts of bounded size, each once and with its vector; a task indexes a
part and meets it with every query. So neither the number of tables nor crowded cells
show in the exchange, and a part's best rows are all that leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a part.
PART_ROWS = 65_536


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    lead = x.shape[:-1]
    while h < n:
        y = x.reshape(*lead, n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(*lead, n)
        h *= 2
    return x / np.float32(np.sqrt(n))


def rotations(vectors: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """Pseudo-rotations of unit vectors, (rows, tables, padded dimension)."""
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, size]).choice(np.array([-1, 1], np.float32), (3, tables, size))
    norm = np.abs(vectors).max(axis=1, keepdims=True)
    x = vectors / norm
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))[:, None, :]
    for s in signs:
        x = hadamard(x * s)
    return x


def signed_axes(vectors: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """How near each row is to each signed axis: (rows, tables, axes and then their negative sides)."""
    x = rotations(vectors, tables, seed)
    return np.concatenate([x, -x], axis=-1)


def cells(vectors: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """The cell of each row in each table."""
    out = [signed_axes(vectors[at:at + 256], tables, seed).argmax(axis=-1) for at in range(0, len(vectors), 256)]
    return np.concatenate(out).astype(np.int32)


def probed(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` nearest cells of each row over all tables, numbered table by table."""
    near = signed_axes(vectors, tables, seed).reshape(len(vectors), -1)
    probes = min(probes, near.shape[1])
    return np.argpartition(-near, probes - 1, axis=1)[:, :probes].astype(np.int32)


class Index:
    """The rows of a part by cell, for each table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tables: int, seed: int):
        self.ids, self.x = ids, x
        c = cells(x, tables, seed)
        axes = 2 << max(1, (x.shape[1] - 1).bit_length())
        self.order = np.argsort(c, axis=0, kind="stable").T
        self.starts = np.stack([np.searchsorted(np.sort(c[:, t]), np.arange(axes + 1)) for t in range(tables)])
        self.axes = axes

    def candidates(self, probes: np.ndarray | None) -> np.ndarray:
        """The rows of the probed cells, each once; without ``probes`` all rows."""
        if probes is None:
            return np.arange(len(self.ids))
        found = np.zeros(len(self.ids), bool)
        for p in probes:
            t, cell = divmod(int(p), self.axes)
            found[self.order[t, self.starts[t, cell]:self.starts[t, cell + 1]]] = True
        return np.flatnonzero(found)

    def nearest(self, query: int, v: np.ndarray, probes: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest candidates but the query itself, ties to the smaller id."""
        rows = self.candidates(probes)
        rows = rows[self.ids[rows] != query]
        d = np.sqrt(((self.x[rows] - v) ** 2).sum(axis=1))
        if len(d) > k:
            edge = np.partition(d, k - 1)[k - 1]
            near = np.flatnonzero(d <= edge)
            rows, d = rows[near], d[near]
        order = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows[order]], d[order]


def _vectors(col: pa.Array) -> list[np.ndarray]:
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, col.value_lengths().to_numpy(zero_copy_only=False)])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _met(rows: DataFrame, asked: DataFrame, k: int, kind: str, tables: int, probes: int | None, seed: int, parts: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows that each query finds in each part; without ``probes`` among all rows."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    held = rows.select(part, F.lit(0).alias("kind"), "id", "v")
    met = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "v")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(met).repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, indexes = None, [], {}
        for b in batches:
            part, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, vectors = b.column(2).to_numpy(), _vectors(b.column(3))
            edges = np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(part)]
            out_q, out_v, out_s = [], [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi <= lo:
                    continue
                if part[lo] != now:
                    now, waiting, indexes = part[lo], [], {}
                if not kinds[lo]:
                    waiting += [(ids[i], vectors[i].astype(kind)) for i in range(lo, hi)]
                    continue
                for dim in {len(v) for _, v in waiting}:
                    mine = [(i, v) for i, v in waiting if len(v) == dim]
                    indexes[dim] = Index(np.array([i for i, _ in mine]), np.stack([v for _, v in mine]).astype(np.float64), tables, seed)
                waiting = []
                for dim in {len(v) for v in vectors[lo:hi]} & set(indexes):
                    which = [i for i in range(lo, hi) if len(vectors[i]) == dim]
                    for at in range(0, len(which), 256):
                        some = which[at:at + 256]
                        x = np.stack([vectors[i] for i in some]).astype(np.float64)
                        cells_ = [None] * len(some) if probes is None else probed(x, tables, probes, seed)
                        for i, v, c in zip(some, x, cells_, strict=True):
                            found, d = indexes[dim].nearest(ids[i], v, c, k)
                            out_q.append(np.full(len(found), ids[i]))
                            out_v.append(found)
                            out_s.append(d)
            if out_q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a), t) for a, t in ((out_q, pa.int64()), (out_v, pa.int64()), (out_s, pa.float64()))],
                    names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    df: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = 10, tables: int = 24, probes: int = 60, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where ``queries`` holds.

    A row is no candidate of its own query. Vectors that are NULL, empty, zero or hold a
    NULL, NaN or infinite component take no part; vectors are compared within one
    length. Of equal vectors only the k + 1 with the smallest keys can be among any
    query's k nearest, so only they are indexed: a hot vector costs no more than others.
    Ties go to the smaller key. A query that finds fewer than k rows while there are
    more is compared with every row. ``probes`` counts the cells of a query over all tables.
    An empty table gives no rows.
    """
    e = F.col(vector)
    good = (
        e.isNotNull() & (F.size(e) > 0) & F.col(key).isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(e, lambda x: x != 0)
    )
    single = df.schema[vector].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    base = df.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), (e if single else e.cast("array<double>")).alias("v"))
    rows = base.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    rows = materialize(rows, "vectors")
    asked = materialize(base.where(queries), "queries")
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(tasks, -(-rows.count() // PART_ROWS))
    found = materialize(_met(rows, asked, k, kind, tables, probes, seed, parts), "nearest")

    # queries with too few candidates meet every row
    got = found.groupBy("query_id").agg(F.count("*").alias("c"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    sized = asked.withColumn("dim", F.size("v")).join(sizes, "dim")
    short = materialize(sized.join(got, sized.id == got.query_id, "left").where(F.coalesce("c", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("id", "v"), "short")
    if short.limit(1).count():
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_met(rows, short, k, kind, tables, None, seed, parts))
    return found.select("query_id", "rank", "vec_id", "score")
