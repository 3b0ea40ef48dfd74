"""Operator 12: maximal repetitions of the words of each document (periodic runs).

A suffix automaton takes the words one by one. The tree of its suffix links is held as
paths of states that last occurred at the same place (a link-cut tree: each path is a
splay tree by depth). An appended word recolours the path from its state to the root; a
path segment that last ended at ``e`` and reaches strings of ``L`` words shows, at end
``i``, that the last ``L`` words stand ``p = i - e`` words earlier too. Where ``p <= L``
that is a square of period ``p``: the words from ``i - L - p + 1`` to ``i`` have period
``p``, no smaller one, and reach as far left as that period does. The same start and
period at later ends extend it to the whole run.

Before that, words that can be in no run are passed over: the first ``length - period``
words of a run stand again a period later, so with runs of ``shortest`` words or more,
every word of a run lies in a window of ``shortest // 2`` words that stands twice within
its stretch. Stretches of such words, most often none, go to the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def stretches(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Ranges of words that lie in windows of ``shortest // 2`` words found twice in the same range: every run lies in one.

    Equal hashes of different windows only make a range longer than it must be.
    """
    width, out, todo = max(1, shortest // 2), [], [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < shortest:
            continue
        key = np.zeros(hi - lo - width + 1, np.uint64)
        for j in range(width):
            key = (key ^ (key >> np.uint64(31))) * MULTIPLIER + ids[lo + j:lo + j + len(key)].astype(np.uint64)
        _, back, found = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(found[back] > 1)
        if not len(twice):
            continue
        cut = np.flatnonzero(np.diff(twice) > width)
        parts = [(lo + int(a), lo + int(b) + width) for a, b in zip(twice[np.r_[0, cut + 1]], twice[np.r_[cut, len(twice) - 1]], strict=True)]
        if parts == [(lo, hi)]:
            out.append((lo, hi))
        else:
            todo += parts
    return sorted(out)


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) to the last word of every maximal stretch with that smallest period and at least two periods.

    State 0 is no state, state 1 the automaton's root. ``up`` is the splay tree's parent, at
    a path's splay root the state that the path hangs from; ``ended`` holds at a splay root
    where the path's strings last ended.
    """
    link, size, following = [0, 0], [0, 0], [{}, {}]
    up, left, right, ended = [0, 0], [0, 0], [0, 0], [-1, -1]

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g

    def splay(x: int) -> None:
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                above = up[g]
                if not above or (left[above] != g and right[above] != g):
                    ended[x] = ended[g]  # g was the root of its path
                if (left[g] == p) == (left[p] == x):
                    rotate(p, g)
                else:
                    rotate(x, p)
                p = up[x]
            else:
                ended[x] = ended[p]
            rotate(x, p)

    found: dict[tuple[int, int], int] = {}
    last = 1
    for i, word in enumerate(words):
        # the automaton takes the word
        new = len(link)
        link.append(0)
        size.append(i + 1)
        following.append({})
        for held in (up, left, right):
            held.append(0)
        ended.append(-1)
        p = last
        while p and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            q = following[p][word]
            if size[q] == size[p] + 1:
                parent = q
            else:
                parent = len(link)  # q's shorter strings become a state of their own, above q on the same path
                link.append(link[q])
                size.append(size[p] + 1)
                following.append(following[q].copy())
                splay(q)
                above = left[q]
                up.append(q)
                left.append(above)
                right.append(0)
                ended.append(-1)
                if above:
                    up[above] = parent
                left[q] = parent
                link[q] = parent
                while p and following[p].get(word) == q:
                    following[p][word] = parent
                    p = link[p]
        link[new] = parent
        last = new
        # the path from the new state to the root gets the colour i
        if parent > 1:
            up[new] = parent
        below, x = new, up[new]
        while x:
            splay(x)
            e = ended[x]
            period, length = i - e, size[x]
            if period <= length:
                found[i - length - period + 1, period] = i
            deeper = right[x]
            if deeper:
                ended[deeper] = e
            right[x] = below
            below, x = x, up[x]
        ended[below] = i
    return found


def runs_of(words: list, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``shortest`` words, by start, then period."""
    if len(words) < shortest:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return []
    out = []
    for lo, hi in stretches(ids, shortest):
        for (start, period), end in squares(ids[lo:hi].tolist()).items():
            if end - start + 1 >= shortest:
                out.append((lo + start, end - start + 1, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        if hi <= at:
            continue
        out += words[at:max(at, lo)]
        at = hi
    return out + words[at:]


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 12) -> DataFrame:
    """(key, n_words, runs, collapsed): the periodic runs of each row's text.

    Words are separated by ASCII white space. A run is a stretch of at least ``shortest``
    words and two periods with smallest period ``period`` that no neighbouring word extends;
    ``runs`` is an array of (start, length, period) by start, then period, starts counted
    from 0. ``collapsed`` holds the words that no run contains after its first period,
    joined by one space. ``shortest`` is at least 2.

    A NULL or empty text has no words, no runs and an empty ``collapsed``; rows with the
    same or a NULL key are rows of their own; an empty table gives an empty result; other
    columns do not matter. No shuffle: a row is a task's own work, a text of n words takes
    n log n steps and memory for those of its words that lie in repeated passages.
    """
    if shortest < 2:
        raise ValueError("shortest must be at least 2")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                counts, runs, kept = [], [], []
                for raw in b.column(1).cast(pa.binary()).to_pylist():
                    words = (raw or b"").split()
                    found = runs_of(words, shortest)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    kept.append(b" ".join(kept_words(words, found)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(counts, pa.int64()), pa.array(runs, RUN), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[key, "n_words", "runs", "collapsed"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
