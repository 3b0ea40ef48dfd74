"""Operator 8: language identification.

Averaged hashed subword embeddings with a linear softmax, trained by stochastic
gradient descent in numpy on a bounded sample, with calibrated rejection. As the output
layer is linear, the trained model folds into one table of logits per subword bucket: a
text's logits are the mean of its subwords' rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches

#: Subwords are runs of 1 to 4 bytes of lower-cased words with a mark on both sides.
SIZES = (1, 2, 3, 4)
_MARK = 32


def buckets(text: str, n_buckets: int) -> np.ndarray:
    """Bucket of every subword of the whole text; digits and signs count as word ends."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
    x = np.where(letter, raw, _MARK).astype(np.uint64)
    x = x[np.r_[True, letter[1:] | letter[:-1]]]  # one mark between words
    mark = x == _MARK
    out = []
    rolled = np.zeros(len(x), dtype=np.uint64)
    inner = np.zeros(len(x), dtype=bool)  # a mark strictly inside the run
    for size in range(1, max(SIZES) + 1):
        n = len(x) - size + 1
        if n <= 0:
            break
        rolled = rolled[:n] * np.uint64(0x9E3779B1) + x[size - 1:] + np.uint64(1)
        if size > 2:
            inner = inner[:n] | mark[size - 2:size - 2 + n]
        else:
            inner = inner[:n]
        if size in SIZES:
            h = rolled[~inner] * np.uint64(0xD6E8FEB86659FD93)
            out.append((h >> np.uint64(40)) % np.uint64(n_buckets))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embeddings times output weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label, calibrated probability, rejected); ``und`` for NULL or a text without a letter."""
        if text is None or not self.labels or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        at = buckets(text, len(self.table))
        counts = np.bincount(at, minlength=len(self.table)) if len(at) > len(self.table) else None
        mean = counts @ self.table / len(at) if counts is not None else self.table[at].mean(axis=0)
        p = _softmax((mean + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(rows: list, n_buckets: int):
    """Mean bucket vectors as (indices, weights) pairs."""
    return [(np.frombuffer(i, dtype="<i4"), np.frombuffer(w, dtype="<f4")) for i, w in rows]


def train(
    features: list[tuple[bytes, bytes]], langs: list[str], n_buckets: int, dim: int = 16, epochs: int = 8, rate: float = 8.0,
    seed: int = 7, reject: float = 0.001,
) -> Model:
    """Stochastic gradient descent over documents; a fifth of the sample calibrates.

    The temperature minimises the log loss of the calibration part; the rejection
    threshold is the score below which ``reject`` of its rightly predicted documents
    lie, and at most an even guess between two labels.
    """
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((n_buckets, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([labels.index(x) for x in langs])
    x = _matrix(features, n_buckets)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5:]
    emb = rng.normal(0, 0.1, (n_buckets, dim))
    out = rng.normal(0, 0.1, (dim, len(labels)))
    bias = np.zeros(len(labels))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            at, w = x[i]
            if not len(at):
                continue
            h = w @ emb[at]
            p = _softmax((h @ out + bias)[None])[0]
            p[y[i]] -= 1
            back = out @ p
            out -= 0.1 * step * np.outer(h, p)
            bias -= 0.001 * step * p
            emb[at] -= step * np.outer(w, back)
    table = emb @ out
    test = held if len(held) else fit
    z = np.array([x[i][1] @ table[x[i][0]] + bias if len(x[i][0]) else bias for i in test])
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean() for t in 2.0 ** np.arange(-3, 4.1, 0.5)}
    temperature = min(loss, key=loss.get)
    p = _softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[test]])
    threshold = min(0.5, float(right[int(reject * len(right))])) if len(right) else 0.0
    return Model(labels, table, bias, float(temperature), threshold)


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400,
    most_rows: int = 80_000, n_buckets: int = 1 << 15,
) -> Model:
    """Trains on at most ``per_language`` rows of each label, fewer if the labels are so many
    that ``most_rows`` would be passed, but one of each at least: no label is left out.

    The rows are those with the smallest hashes of ``key``, so the sample is even and
    repeatable. Executors turn the sampled texts into bucket counts; the driver gets at
    most ``most_rows`` rows, or one a label, of at most ``n_buckets`` counts. Rows whose label is NULL or
    whose text is NULL or without a letter teach nothing; repeated rows may be drawn
    each; without any row the model knows no label and rejects all.
    """
    short_batches(labelled.sparkSession)
    schema = "lang string, at binary, weight binary"
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"))
    # count first, then let only hashes below a share of each label through, so that few rows meet in a label's task
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [], n_buckets)
    per_language = max(1, min(per_language, most_rows // len(counts)))
    shares = [(la, min(1.0, (2 * per_language + 50) / n)) for la, n in counts.items()]  # so many that no label ends up without a row
    limit = F.create_map(*[F.lit(x) for la, share in shares for x in (la, float(share))])[F.col("lang")]
    rows = rows.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= limit)
    order = Window.partitionBy("lang").orderBy("h", "k", "text")
    sample = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for la, t in zip(f["lang"], f["text"], strict=True):
                at, n = np.unique(buckets(t, n_buckets), return_counts=True)
                out.append((la, at.astype("<i4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "at", "weight"])

    got = sample.select("lang", "text").mapInPandas(count, schema).collect()
    got = sorted((r["lang"], bytes(r["at"]), bytes(r["weight"])) for r in got)
    return train([g[1:] for g in got], [g[0] for g in got], n_buckets)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``rejected``; only the text is used.

    A NULL text or one without a letter gives ``und``, score 0, rejected. Rows are
    independent; other columns pass through, columns named like the results are replaced.
    """

    short_batches(df.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang_pred", "score", "rejected"])

    names = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    out = df.select(*[F.col(f"`{c}`") for c in names], run(F.col(text)).alias("__lid"))
    return out.select(*[F.col(f"`{c}`") for c in names], "__lid.*")
