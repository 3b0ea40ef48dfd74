"""Operator 11: hard negatives by Kronecker-packed products.

Components are whole numbers. Those of several candidates are made non-negative and laid
side by side as separated fields of one wide integer, so one multiplication by a
component of an anchor multiplies them all; the sum over components holds each
candidate's inner product in its own field, from which it is read back exactly. Wide
integers of up to 53 bits are carried as doubles, which hold them exactly, so a block of
anchors and a block of candidates is one matrix product; wider fields use Python's integers.

Anchors and rows are dealt in blocks: every block of anchors meets every block of rows in
one task, which holds the anchors and keeps the best few of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of a whole number that a double holds exactly.
EXACT = 53
#: Anchors a task holds, rows of a block, and anchors and rows of one matrix product.
ANCHOR_BLOCK, ROW_BLOCK, ANCHOR_TILE, ROW_TILE = 4096, 65536, 512, 1024


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(anchors, rows) exact inner products of integer vectors; raises OverflowError beyond 64 bits."""
    (na, d), nr = anchors.shape, len(rows)
    if not (na and nr and d):
        return np.zeros((na, nr), np.int64)
    bias = max(0, -int(rows.min()))
    norm = int(np.abs(anchors).sum(axis=1, dtype=object).max()) if max(abs(int(anchors.min())), abs(int(anchors.max()))) > 1 << 40 else int(np.abs(anchors).sum(axis=1).max())
    width = (norm * (int(rows.max()) + bias)).bit_length() + 1
    fields = EXACT // width
    kind = float if fields else object
    fields = min(nr, fields or 8)
    lanes = -(-nr // fields)
    shifted = np.zeros((lanes * fields, d), kind)
    shifted[:nr] = rows.astype(object) + bias if kind is object else rows + bias
    wide = shifted[:lanes].copy()
    for f in range(1, fields):
        wide += shifted[f * lanes:(f + 1) * lanes] * (kind(1 << width * f) if kind is float else 1 << width * f)
    product = anchors.astype(kind) @ wide.T
    half = 1 << (width - 1)
    product = (product.astype(np.int64) if kind is float else product) + sum(half << width * f for f in range(fields))
    parts = [((product >> width * f) & ((1 << width) - 1)) - half for f in range(fields)]
    sums = anchors.sum(axis=1, dtype=object) if kind is object else anchors.sum(axis=1)
    out = np.concatenate(parts, axis=1)[:, :nr] - (sums * bias)[:, None]
    return out if kind is float else out.astype(np.int64)


class Best:
    """The best few (score, id) of each of several lists: higher scores first, ties by smaller id."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.owner, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(lists, np.iinfo(np.int64).min)

    def offer(self, owner: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(owner):
            return
        o, s, i = np.r_[self.owner, owner], np.r_[self.score, score], np.r_[self.id, ident]
        order = np.lexsort((i, -s, o))
        o, s, i = o[order], s[order], i[order]
        first = np.r_[0, np.flatnonzero(o[1:] != o[:-1]) + 1]
        place = np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)]))
        full = place == self.most - 1
        self.least[o[full]] = s[full]
        kept = place < self.most
        self.owner, self.score, self.id = o[kept], s[kept], i[kept]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _searched(blocks: DataFrame, most: int, banded: bool, low: int, high: int) -> DataFrame:
    """The best rows for the anchors of each block.

    Without ``banded`` those with the anchor's label (place is 0); with it, for each of the
    anchor's positives (place is its number), those of other labels whose score lies in its band.
    """
    parts = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, state = None, {}, {}

        def done() -> Iterator[pa.RecordBatch]:
            for dim, best in state.items():
                ids, lists = held[dim][0], held[dim][4]
                a, p = lists[0][best.owner], lists[1][best.owner]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(p.astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "place", "vec_id", "score"])

        def settle(pieces: list[pa.RecordBatch]) -> None:
            """The block's anchors are all here."""
            t = pa.Table.from_batches(pieces)
            dims = t["dim"].to_numpy()
            for dim in np.unique(dims):
                g = t.filter(pa.array(dims == dim)).combine_chunks()
                v = _matrix(g["v"].chunk(0), dim)
                given = g["asked"].chunk(0)
                sizes = given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) if banded else np.ones(g.num_rows, np.int64)
                owner = np.repeat(np.arange(g.num_rows), sizes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                top = given.flatten().to_numpy(zero_copy_only=False) if banded else np.full(len(owner), np.iinfo(np.int64).max)
                held[dim] = (g["id"].to_numpy(), g["label"].to_numpy(), v, top, (owner, place))
                state[dim] = Best(len(owner), most)

        def meet(b: pa.RecordBatch) -> None:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in held:
                    continue
                g = b.filter(pa.array(dims == dim))
                ids, labels, v, top, (owner, place) = held[dim]
                rid, rlab, rows, best = g.column("id").to_numpy(), g.column("label").to_numpy(), _matrix(g.column("v"), dim), state[dim]
                for lab in np.unique(rlab) if not banded else [None]:
                    cols = np.flatnonzero(rlab == lab) if not banded else np.arange(len(rid))
                    who = np.flatnonzero(labels[owner] == lab) if not banded else np.arange(len(owner))
                    for at in range(0, len(who), ANCHOR_TILE):
                        mine = who[at:at + ANCHOR_TILE]
                        anchor, back = np.unique(owner[mine], return_inverse=True)
                        s = packed_products(v[anchor], rows[cols])[back]
                        want = (ids[owner[mine]][:, None] != rid[cols]) & (s >= best.least[mine][:, None])
                        if banded:
                            p = top[mine]
                            floor = np.array([-(-low * int(x) // high) for x in p], dtype=np.int64)
                            want &= (labels[owner[mine]][:, None] != rlab[cols]) & (s <= p[:, None]) & (s >= floor[:, None])
                        i, j = np.nonzero(want)
                        best.offer(mine[i], s[i, j], rid[cols][j])

        waiting: list[pa.RecordBatch] = []
        for whole in batches:
            for begin in range(0, whole.num_rows, ROW_TILE):
                b = whole.slice(begin, ROW_TILE)
                block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
                edges = np.r_[0, np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1, len(block)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if block[lo] != now:
                        yield from done()
                        now, held, state, waiting = block[lo], {}, {}, []
                    part = b.slice(lo, hi - lo)
                    if not kind[lo]:
                        waiting.append(part)
                        continue
                    if waiting:
                        settle(waiting)
                        waiting = []
                    if held:
                        meet(part)
        yield from done()

    return dealt.mapInArrow(run, "anchor_id long, place int, vec_id long, score long")


def hard_negatives(
    df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
    positives: int = 5, most: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row where ``anchors`` holds (on a column ``id``).

    Each component x becomes floor(scale * x); a row's score is its inner product with the
    anchor. An anchor's positives are its best ``positives`` rows of the same label; for
    each of them come the best ``most`` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score. Higher scores come first, ties
    by smaller key. All rows are compared with all anchors; nothing is left out.

    Rows with a NULL key, label or vector, or a NULL, NaN or infinite component take no
    part; vectors meet within one length (an empty vector's products are 0). Of rows with one
    key the one with the least label and vector counts. An anchor without another row of its label, or with no row
    in a band, gives no rows; an empty table gives none. Scores beyond 64 bits raise OverflowError.
    """
    e = F.col(vector)
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = df.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), whole.alias("v")).alias("r"))
    rows = materialize(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v", F.size("r.v").alias("dim")), "rows")
    asked = rows.where(anchors)
    n, count = rows.agg(F.count("*"), F.count_if(anchors)).first()
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    anchor_blocks, row_blocks = max(1, -(-count // ANCHOR_BLOCK)), max(parts, -(-n // ROW_BLOCK))
    block = lambda a, r: (a.cast("long") * row_blocks + r.cast("long")).alias("block")
    spread = lambda c, k, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def search(who: DataFrame, keep: int, banded: bool) -> DataFrame:
        held = who.withColumn("r", every(row_blocks)).select(block(spread("id", anchor_blocks, 1), F.col("r")), F.lit(0).alias("kind"), "id", "label", "dim", "v", "asked")
        met = rows.withColumn("a", every(anchor_blocks)).select(block(F.col("a"), spread("id", row_blocks, 2)), F.lit(1).alias("kind"), "id", "label", "dim", "v", F.lit(None).cast("array<long>").alias("asked"))
        found = _searched(held.unionByName(met), keep, banded, low, high)
        order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    best = materialize(search(asked.withColumn("asked", F.lit(None).cast("array<long>")), positives, False).select("anchor_id", "rank", "vec_id", "score"), "positives")
    lists = best.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("asked"))
    found = search(asked.join(lists, F.col("id") == F.col("anchor_id")).drop("anchor_id"), most, True)
    named = best.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
