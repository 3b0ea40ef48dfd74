"""Operator 9: harmonic packing of token ids into fixed-length sequences.

Lengths fall into classes (capacity/(k+1), capacity/k]; a bin of class k holds k pieces.
Every worker fills its own bins, so nothing is shuffled. A document is cut into full
sequences and a rest; the rest gives up to ``cuts`` pieces of exactly capacity/k and
ends in a piece of a small class, where little is lost. What is left open when a worker
ends is laid end to end, so a worker pads one sequence beyond the classes' own waste.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches


def cut(n: int, capacity: int, cuts: int = 3, waste: float = 0.02) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if cuts <= 0 or capacity // k - rest <= waste * rest:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
        cuts -= 1
    return out


class Encoder:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file, as numpy arrays.

    Latin-script texts without special strings are encoded by a faster library from the
    same vocabulary as ranks; the tests hold both against each other.
    """

    PLAIN = "ɐ"

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import base64
        import json

        self.path, self._library = path, None
        with open(path) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @property
    def library(self):
        """Loaded with the first text that needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ids(self, text: str) -> np.ndarray:
        if self.fast and (text.isascii() or max(text) < self.PLAIN) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder_for(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    """A worker loads a vocabulary once."""
    return Encoder(path, ranks, pattern)


class Bins:
    """The open bins of one worker."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}

    def _close(self, pieces: list) -> list[tuple]:
        at, seq, out = 0, self.next, []
        self.next += 1
        for doc, start, ids, total in pieces:
            out.append((doc, start, ids, total, seq, at))
            at += len(ids)
        return out

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> list[tuple]:
        k = self.capacity // len(ids)
        held = self.open.setdefault(k, [])
        held.append((doc, start, ids, total))
        return self._close(self.open.pop(k)) if len(held) == k else []

    def finish(self) -> list[tuple]:
        """Lays the pieces of all open bins end to end."""
        out, current, room = [], [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while len(ids):
                    current.append((doc, start, ids[:room], total))
                    used = len(current[-1][2])
                    start, ids, room = start + used, ids[used:], room - used
                    if not room:
                        out += self._close(current)
                        current, room = [], self.capacity
        self.open = {}
        return out + (self._close(current) if current else [])


def pack(
    df: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, doc: str = "doc_id", text: str = "text",
    capacity: int = 1024, end_id: int = 0, cuts: int = 3,
) -> DataFrame:
    """One row per piece: doc, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Each document is its ids and then ``end_id``; a NULL or empty text is ``end_id`` alone.
    Sequence numbers are unique (worker number and a count), not gapless. Repeated rows
    are packed each; other columns are not carried; an empty table gives no rows.
    """
    schema = f"`{doc}` {df.schema[doc].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = encoder_for(path, ranks, pattern), Bins(capacity, TaskContext.get().partitionId() << 36)
        kind = None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*placed, strict=True)) if placed else [[]] * 6
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array([len(x) for x in cols[2]], pa.int64()),
                pa.array([x.tobytes() for x in cols[2]], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                pa.array(cols[5], pa.int64()),
            ], names=[doc, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            kind = b.schema.field(0).type
            placed: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encoder.ids(t.as_py() or ""), np.array([end_id], dtype="<u4"))
                start = 0
                for n in cut(len(ids), capacity, cuts):
                    placed += bins.add(d, start, ids[start:start + n], len(ids))
                    start += n
                if len(placed) > 4096:
                    yield rows(placed)
                    placed = []
            if placed:
                yield rows(placed)
        if kind is not None:
            yield rows(bins.finish())

    short_batches(df.sparkSession)
    return df.select(F.col(doc), F.col(text)).mapInArrow(run, schema)
