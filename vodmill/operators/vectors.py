"""Embedding generations: codec, normalisation, exact cosine top-k, evaluation, missing rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Query vectors held at once by a worker; larger query sets go in blocks.
QUERY_BLOCK = 4096
#: Bytes of row vectors that meet a query block in a task, and rows scored at once.
ROW_BYTES, ROW_SLICE = 16 << 20, 1024


@F.pandas_udf(BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """float32 bytes, little-endian."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


def decode_vector(blob: Column, dim: Column) -> Column:
    """The vector of a blob of 4 x dim bytes; NULL for any other length."""

    @F.pandas_udf("array<float>")
    def run(b: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) != 4 * n else np.frombuffer(x, dtype="<f4") for x, n in zip(b, d, strict=True)])

    return run(blob, dim)


def l2_normalize(v: Column) -> Column:
    """Unit vector in doubles; NULL for empty, non-finite or zero vectors."""
    x = v.cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    return F.when((F.size(x) > 0) & ~bad & (norm > 0), F.transform(x, lambda e: e / norm))


def generation(embeddings: DataFrame, traces: DataFrame, model: str, dim: int) -> DataFrame:
    """Normalised vectors of one generation with their visual traces."""
    e = embeddings.where((F.col("model_id") == model) & (F.col("embedding_dimension") == dim) & F.col("normalized"))
    return e.join(traces.where("trace_type = 'visual'").select("trace_id", "media_id", "start_ms"), "trace_id")


def missing_embeddings(traces: DataFrame, embeddings: DataFrame, model: str, dim: int, limit: int | None = None) -> DataFrame:
    """Traces without a vector of the generation; a limit counts in (media, start, trace) order before that test."""
    t = traces.where("trace_type = 'visual'")
    t = t.orderBy("media_id", "start_ms", "trace_id").limit(limit) if limit else t
    have = embeddings.where((F.col("model_id") == model) & (F.col("embedding_dimension") == dim)).select("trace_id")
    return t.join(have, "trace_id", "left_anti")


def embed_missing(missing: DataFrame, make_backend: Callable[[], Callable[[list], np.ndarray]], model: str, dim: int, content: str) -> DataFrame:
    """Vectors of a caller's model, loaded once per worker, checked, normalised and marked with the generation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for b in batches:
            x = np.asarray(backend(list(b[content])), dtype=np.float64)
            if x.shape != (len(b), dim):
                raise ValueError(f"the model gave {x.shape}, not {(len(b), dim)}")
            norm = np.linalg.norm(x, axis=1)
            if not np.isfinite(x).all() or (norm == 0).any():
                raise ValueError("the model gave a vector that is not finite or is zero")
            unit = (x / norm[:, None]).astype("<f4")
            yield pd.DataFrame({"trace_id": b["trace_id"], "model_id": model, "embedding_dimension": dim, "vector": list(unit), "normalized": True})

    t = missing.schema["trace_id"].dataType.simpleString()
    return missing.select("trace_id", content).mapInPandas(run, f"trace_id {t}, model_id string, embedding_dimension int, vector array<float>, normalized boolean")


def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


#: Up to so many queries a row is tested for being passed over; with more, one of them nearly always wants it.
TESTED_QUERIES = 64
#: What rounding of scores and sums may add to a bound.
_SLACK = 1e-7


class Prefixes:
    """The best rows of a block of queries for several dimensions at once.

    One pass over the components: products and squared lengths are summed up from the
    smallest dimension to the largest, and give the cosine of every prefix on the way. By
    Cauchy and Schwarz a row's cosine at a larger dimension is at most the product so far
    plus the product of what is left of both lengths; a row that so stays below the last of the best of every
    query, at every dimension still to come, is passed over. ``done`` and ``whole`` count
    multiplications as made and as they would be without.
    """

    def __init__(self, queries: np.ndarray, dims: list[int], k: int):
        top = max(dims)
        if queries.shape[1] < top:
            raise ValueError(f"dimension {top} is above {queries.shape[1]}")
        self.q, self.k, self.dims = queries, k, sorted(dims)
        self.stages = sorted({*self.dims, *((top // 4, top // 2) if top >= 32 else ())})
        self.lengths = np.cumsum(queries * queries, axis=1)
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.done = self.whole = 0

    def _kept(self, d: int, s: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        i = np.broadcast_to(ids, s.shape)
        if s.shape[1] > k:  # of equal scores at the edge the smaller keys stay
            edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            above, same = s > edge, s == edge
            keep = above | same & (np.cumsum(same, axis=1) <= k - above.sum(axis=1, keepdims=True))
            s, i = s[keep].reshape(-1, k), i[keep].reshape(-1, k)
        if d in self.best:
            s, i = (np.concatenate(p, axis=1) for p in zip(self.best[d], (s, i), strict=True))
        place = np.lexsort((i, -s), axis=1)[:, :k]
        self.best[d] = tuple(np.take_along_axis(a, place, axis=1) for a in (s, i))

    def _hopeful(self, at: int, product: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which rows may still be among the best of some query at a dimension above ``at``."""
        out = np.zeros(product.shape[1], bool)
        for e in self.dims:
            if e <= at:
                continue
            if e not in self.best or self.best[e][0].shape[1] < self.k:
                return np.ones(product.shape[1], bool)
            left_q, left_x = self.lengths[:, e - 1] - self.lengths[:, at - 1], lengths[:, e - 1] - lengths[:, at - 1]
            most = product + np.sqrt(np.maximum(left_q, 0))[:, None] * np.sqrt(np.maximum(left_x, 0))[None, :]
            scale = np.maximum(np.sqrt(self.lengths[:, e - 1])[:, None] * np.sqrt(lengths[:, e - 1])[None, :], 1e-300)
            out |= ~(most / scale + _SLACK < self.best[e][0][:, -1:]).all(axis=0)
        return out

    def hold(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows with their keys; a dimension above theirs raises ValueError."""
        if x.shape[1] < self.dims[-1]:
            raise ValueError(f"dimension {self.dims[-1]} is above {x.shape[1]}")
        order = np.argsort(ids, kind="stable")
        for begin in range(0, len(ids), ROW_SLICE):
            part = order[begin : begin + ROW_SLICE]
            rows, keys = x[part], ids[part]
            lengths = np.cumsum(rows * rows, axis=1)
            product, before = np.zeros((len(self.q), len(part))), 0
            self.whole += len(self.q) * len(part) * self.dims[-1]
            for d in self.stages:
                product += self.q[:, before:d] @ rows[:, before:d].T
                self.done += len(self.q) * len(rows) * (d - before)
                if d in self.dims:
                    scale = np.maximum(np.sqrt(self.lengths[:, d - 1])[:, None] * np.sqrt(lengths[:, d - 1])[None, :], 1e-300)
                    s = np.round(np.clip(product / scale, -1, 1), 8)
                    s[np.isnan(s)] = -np.inf
                    self._kept(d, s, keys)
                before = d
                if d < self.dims[-1] and len(self.q) <= TESTED_QUERIES:
                    hope = self._hopeful(d, product, lengths)
                    if not hope.all():
                        rows, keys, lengths, product = rows[hope], keys[hope], lengths[hope], product[:, hope]
                    if not len(rows):
                        break


def _found(best: dict, qid: np.ndarray, key: str) -> Iterator[pa.RecordBatch]:
    for d, (s, i) in best.items():
        q = np.repeat(qid, s.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d), pa.int32()), pa.array(q, pa.int64()), pa.array(i.reshape(-1), pa.int64()), pa.array(s.reshape(-1))], names=["dimension", "query_id", key, "score"])


def cosine_top_k(rows: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int, dims: list[int] | None = None, key: str = "trace_id", vector: str = "vector") -> DataFrame:
    """K3, K4: (dimension, query_id, rank, key, score): exact cosine of unit vectors, best first, ties to the smaller key.

    ``queries``: rows (query_id, vector), or a list of such pairs, as many as wanted. Up
    to QUERY_BLOCK are sent to the tasks that hold the rows. More are dealt into blocks
    of about that size, rows into parts of about ROW_BYTES, and each block meets each
    part in a task. For each dimension both sides are cut to their first components and
    made unit again. Each task keeps k rows per query. Scores are held to -1..1 and
    rounded to 8 places. A dimension above the vectors' own raises ValueError on a worker.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not isinstance(queries, DataFrame):
        queries = rows.sparkSession.createDataFrame(queries, "query_id long, vector array<double>")
    queries = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    first = queries.limit(QUERY_BLOCK + 1).collect()
    wanted = dims or ([len(first[0]["vector"])] if first else [])
    rows = rows.select(F.col(key).cast("long"), vector)
    shape = f"dimension int, query_id long, {key} long, score double"
    if len(first) <= QUERY_BLOCK:
        qid = np.array([q["query_id"] for q in first], dtype=np.int64)
        qv = np.array([q["vector"] for q in first], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Prefixes(qv, wanted, k) if len(qid) else None
            for b in batches:
                if b.num_rows and best:
                    best.hold(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), b.num_rows))
            if best:
                yield from _found(best.best, qid, key)

        found = rows.mapInArrow(run, shape)
    else:
        blocks = -(-queries.count() // QUERY_BLOCK)
        parts = max(1, -(-rows.count() * 4 * len(first[0]["vector"]) // ROW_BYTES))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = queries.select("query_id", "vector", dealt("query_id", blocks).alias("__block"), numbers(parts).alias("__part"))
        right = rows.select(key, vector, dealt(key, parts).alias("__part"), numbers(blocks).alias("__block"))

        def meet(q: pa.Table, r: pa.Table) -> pa.Table:
            out = []
            if q.num_rows and r.num_rows:
                ids, x = r.column(0).to_numpy(), _matrix(r.column(1).combine_chunks(), r.num_rows)
                for at in range(0, q.num_rows, QUERY_BLOCK):
                    some = q.slice(at, QUERY_BLOCK)
                    best = Prefixes(_matrix(some.column(1).combine_chunks(), some.num_rows), wanted, k)
                    best.hold(ids, x)
                    out += _found(best.best, some.column(0).to_numpy(), key)
            names = ["dimension", "query_id", key, "score"]
            return pa.Table.from_batches(out, pa.schema(list(zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True))))

        found = left.groupBy("__block", "__part").cogroup(right.groupBy("__block", "__part")).applyInArrow(meet, shape)
    w = Window.partitionBy("dimension", "query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def check_spec(spec: dict, native: int) -> dict:
    """Validates an evaluation spec (dimensions, topK, queries) and gives its counts; raises ValueError naming the fault."""
    dims, queries = spec.get("dimensions") or [], spec.get("queries") or []
    if not dims or any(not isinstance(d, int) or d <= 0 for d in dims) or len(set(dims)) != len(dims):
        raise ValueError("dimensions must be distinct positive whole numbers")
    if max(dims) > native:
        raise ValueError(f"dimension {max(dims)} is above {native}")
    if not isinstance(spec.get("topK"), int) or spec["topK"] <= 0:
        raise ValueError("topK must be positive")
    ids = [q.get("id") for q in queries]
    if not queries or len(set(ids)) != len(ids) or not all(ids):
        raise ValueError("queries need distinct ids")
    for q in queries:
        if q.get("kind") not in ("positive", "control") or not str(q.get("text") or "").strip():
            raise ValueError(f"query {q['id']} needs a kind (positive or control) and a text")
    kinds = [q["kind"] for q in queries]
    return {"dimensions": sorted(dims, reverse=True), "top_k": spec["topK"], "positive": kinds.count("positive"), "control": kinds.count("control")}


def present(matches: DataFrame, traces: DataFrame, media: DataFrame) -> DataFrame:
    """Titles and labels join after the ranking; matches without a trace drop out, scores stay."""
    return matches.join(traces.select("trace_id", "media_id", "start_ms"), "trace_id").join(media.select("media_id", "title", "filename", "media_kind"), "media_id", "left")


def refine_ranking(frames: DataFrame, k: int, group: str = "coarse_id") -> DataFrame:
    """K5: the best local frames of each coarse hit: score, then earlier time; offset from the coarse time."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "timestamp_ms")
    return frames.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("offset_ms", F.col("timestamp_ms") - F.col("coarse_ms"))
