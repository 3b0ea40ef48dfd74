"""Operator 7: SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (dummy prefix, spaces to
the mark), the pieces as a tree of symbol arcs whose accepting states put out an id with
a weight, and byte fallback for characters without a piece. Composed with an input they
span a lattice of states (place, last piece); its tropical shortest path is the encoding.

For a unigram model an arc weighs the negative score of its piece, and the last piece is
no part of a state. The merges of a BPE model are no sum of scores: there every arc weighs
nothing, and a filter lets an arc follow only a piece that the merges would leave
standing beside its own. The start is followed by any piece that its own merges make.
No arc reaches over two characters that stand side by side in no piece, so the lattice
falls apart between them: each run between such places is composed alone and remembered,
as is each run of marks with the text up to the next one.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

MARK = "▁"
NORMAL, UNKNOWN, UNUSED, BYTE = 1, 2, 5, 6
OUT = ""  # no symbol: what an accepting state puts out
START = -(1 << 40)  # stands for the last piece before the first


class Transducer:
    def __init__(self, path: str, remembered: int = 500_000):
        import regex
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only identity normalisers with escaped spaces are compiled here")
        self.prefix = bool(spec.add_dummy_prefix)
        self.bpe = model.trainer_spec.model_type == 2
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.names = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.byte = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        #: Below every score: what a character without a piece weighs in a unigram model.
        self.low = min(p.score for p in model.pieces if p.type == NORMAL) - 10
        self.root = self._tree()
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece reaches over a word's end")
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, UNUSED) else b" \xe2\x81\x87 " if p.type == UNKNOWN else b""
            for p in model.pieces
        ]
        self.split = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        #: Characters that stand side by side in a piece.
        self.joined = {x[i:i + 2] for x in self.pieces for i in range(len(x) - 1)}
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.remembered = remembered
        self.directly = 0  # words that the lattice had no path for

    def _tree(self) -> dict:
        """The pieces' machine: arcs by symbol; under OUT an accepting state has (id, weight)."""
        root: dict = {}
        for piece, k in self.pieces.items():
            state = root
            for c in piece:
                state = state.setdefault(c, {})
            state[OUT] = (k, 0.0 if self.bpe else -self.score[k])
        return root

    def merged(self, text: str) -> list[str]:
        """The pieces that the merge rules leave of a text: best score first, leftmost of equals."""
        parts: list[str | None] = list(text)
        right = [*range(1, len(parts)), -1]
        left = [-1, *range(len(parts) - 1)]
        waiting: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            k = self.pieces.get(parts[i] + parts[j])
            if k is not None:
                heapq.heappush(waiting, (-self.score[k], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while waiting:
            _, i, j, both = heapq.heappop(waiting)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p is not None]

    def _follows(self, last: int, k: int) -> bool:
        """The arc filter: whether the merges leave pieces ``last`` and ``k`` side by side; START is no piece."""
        known = self.beside.get((last, k))
        if known is None:
            two = [self.names[x] for x in (last, k) if x != START]
            known = self.beside[(last, k)] = self.merged("".join(two)) == two
        return known

    def _arcs(self, word: str, at: int) -> list[tuple[int, int, float]]:
        """(place, id, weight) of the composed machine's arcs from a place; a character without a piece is -1 less its code point."""
        state, end, n, arcs = self.root, at, len(word), []
        while end < n and (state := state.get(word[end])) is not None:
            end += 1
            if OUT in state:
                arcs.append((end, *state[OUT]))
        if not arcs or arcs[0][0] > at + 1:
            arcs.append((at + 1, -1 - ord(word[at]), 0.0 if self.bpe else -self.low))
        return arcs

    def _path(self, word: str) -> list[int] | None:
        """Shortest path through the lattice of one word, as ids.

        The cheapest arc goes first and of equals the one that reaches farthest, so a state
        is settled when it is first met. No merge reaches over a character without a piece,
        so any piece may stand beside it.
        """
        n, bpe, beside = len(word), self.bpe, self.beside
        # arcs of equal weight come longest last, so a stack already has the farthest on top
        push, pop = (list.append, list.pop) if bpe else (heapq.heappush, heapq.heappop)
        settled: dict[tuple[int, int], tuple[int, int, int]] = {}
        waiting = [(0.0, 0, 0, START, START)]  # cost, less the place reached, place left, last piece there, piece
        while waiting:
            cost, to, at, last, k = pop(waiting)
            to = -to
            if bpe and k >= 0 and (last >= 0 or last == START):
                fits = beside.get((last, k))
                if not (self._follows(last, k) if fits is None else fits):
                    continue
            here = (to, k if bpe else 0)
            if here in settled:
                continue
            settled[here] = (at, last, k)
            if to == n:
                out = []
                while to:
                    at, last, k = settled[here]
                    out.append(k)
                    to, here = at, (at, last if bpe or not at else 0)
                return out[::-1]
            for end, piece, weight in self._arcs(word, to):
                push(waiting, (cost + weight, -end, to, k, piece))
        return None

    def _run(self, run: str) -> bytes:
        path = self._path(run)
        if path is None:  # merges that no pair of neighbours tells
            self.directly += 1
            path = [self.pieces.get(p, -1 - ord(p[0])) for p in self.merged(run)]
        ids: list[int] = []
        for k in path:
            if k >= 0:
                ids.append(k)
            else:
                ids += [self.byte[b] for b in chr(-1 - k).encode("utf-8", "surrogatepass")]
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        joined, runs, start, out = self.joined, self.runs, 0, []
        for at in [i for i in range(1, len(word)) if word[i - 1:i + 1] not in joined] + [len(word)]:
            run = word[start:at]
            ids = runs.get(run)
            if ids is None:
                ids = runs[run] = self._run(run)
            out.append(ids)
            start = at
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if len(self.words) > self.remembered:
            self.words.clear()
        if len(self.beside) > 4 * self.remembered:
            self.beside.clear()
        if len(self.runs) > self.remembered:
            self.runs.clear()
        words = self.split((MARK if self.prefix else "") + text.replace(" ", MARK))
        known = self.words
        for w in set(words).difference(known):
            known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """A worker compiles a model once; what it remembers of words stays bounded."""
    return Transducer(path)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (little-endian 32-bit) and ``decoded`` (the text that these ids give back).

    A NULL or empty text gives empty ids and ''. Rows are independent; other columns pass
    through, columns named ids or decoded are replaced.
    """

    short_batches(df.sparkSession)

    @F.pandas_udf("ids binary, decoded string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = compiled(path)
        for s in texts:
            ids = [machine.encode(t or "") for t in s]
            yield pd.DataFrame({"ids": ids, "decoded": [machine.decode(i) for i in ids]})

    names = [c for c in df.columns if c not in ("ids", "decoded")]
    out = df.select(*[F.col(f"`{c}`") for c in names], run(F.col(text)).alias("__sp"))
    return out.select(*[F.col(f"`{c}`") for c in names], "__sp.*")
