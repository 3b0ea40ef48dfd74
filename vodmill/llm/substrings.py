"""Operator 13: removal of passages that stand in an earlier document, by level-wise doubling.

A window of ``2n`` words is known by the keys of its two halves of ``n``, so each level
names the windows of the next. Only windows that repeat at one level are looked at on the
next, of up to twice the words, until the length asked for is reached or nothing
repeats any more. On the first level a window of the second stands for itself by the
least key among its parts, so about a quarter of the shortest windows are exchanged, and
a longer window can only repeat where its least part does.

A text that an earlier document has as a whole is settled by that alone and takes no part in
the levels. The other documents meet by key: a slice of documents settles what it can among its own (a
passage that many of them share costs one row a slice), the rest is dealt by key, and
what a document learns returns to it as a list of its own keys. Texts are exchanged once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_left_join

#: Bytes of text whose words are held at a time.
SLICE = 4 << 20
#: Words of the shortest windows, where the window asked for is longer.
FIRST = 7
#: Hash keys of the two namings of words.
NAMINGS = ("words of a text.", "words once again")
_ODD, _LAST = np.uint64(0x9E3779B97F4A7C15), np.iinfo(np.int64).max


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths of the windows, each at most twice the one before, the last being ``window``."""
    out = [window]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of two windows that follow one another."""
    h = (a ^ (a >> np.uint64(32))) * _ODD + b
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Words:
    """The words of some texts, each text's in a row: hashes, the text of each, its first place."""

    def __init__(self, texts: pa.Array, second: bool = False):
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, "")) if len(texts) else pa.array([], pa.list_(pa.string()))
        flat = parts.flatten()
        doc = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
        real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not real.all():
            flat, doc = flat.filter(pa.array(real)), doc[real]
        self.flat, self.doc = flat, doc
        self.counts = np.bincount(doc, minlength=len(parts))
        self.starts = np.cumsum(self.counts) - self.counts
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.hashes = [pd.util.hash_array(names, hash_key=k, categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64) for k in NAMINGS[:1 + second]]

    def keys(self, length: int, which: int = 0) -> np.ndarray:
        """Keys of all windows of ``length`` words, named by doubling; those that reach over a text's end mean nothing."""
        h, have = self.hashes[which], 1
        while have < length:
            step = min(have, length - have)
            h = mixed(h[:max(0, len(h) - step)], h[step:]) if len(h) > step else h[:0]
            have += step
        return h

    def inside(self, length: int) -> np.ndarray:
        """Whether the window of ``length`` words that starts at a place stays in its text."""
        n = max(0, len(self.doc) - length + 1)
        return self.doc[:n] == self.doc[length - 1:length - 1 + n]


def least_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """The least key among ``parts`` that follow one another, for each start."""
    n = max(0, len(keys) - parts + 1)
    out = keys[:n].copy()
    for j in range(1, parts):
        np.minimum(out, keys[j:j + n], out=out)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each, but for a single long one, take ``SLICE`` bytes at most."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), SLICE, "right")))
            yield b.slice(at, n)
            at += n


def _distinct(doc: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Places of the first of each (keys, doc), in this order."""
    order = np.lexsort((doc, *keys[::-1]))
    if not len(order):
        return order
    same = doc[order][1:] == doc[order][:-1]
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    return order[np.r_[True, ~same]]


def settled(ids: np.ndarray, keys: list[np.ndarray], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, kind) of one (key, document) each: 0 to be asked for, 1 a witness only, 2 settled within the slice.

    Before the last length a key of several documents is settled for all of them; at the
    last one for all but the least, which other slices may still precede.
    """
    at = _distinct(ids, keys)
    if not len(at):
        return at, np.zeros(0, np.int8)
    head = np.ones(len(at), bool)
    for k in keys:
        head[1:] &= k[at][1:] == k[at][:-1]
    head[1:] = ~head[1:]
    group = np.cumsum(head) - 1
    many = np.bincount(group)[group] > 1
    kind = np.zeros(len(at), np.int8)
    if last:
        kind[~head] = 2
        return at, kind
    kind[many] = 2
    more = at[head & many]
    return np.r_[at, more], np.r_[kind, np.ones(len(more), np.int8)]


def _rows(ids: np.ndarray, keys: list[np.ndarray], last: bool) -> pa.RecordBatch:
    """What a slice sends out: a witness has no id; what is settled has a salt that spreads it."""
    at, kind = settled(ids, keys, last)
    salt = np.where(kind == 2, (ids[at].astype(np.uint64) * _ODD >> np.uint64(34)).astype(np.int32) + 1, 0).astype(np.int32)
    second = (keys[1][at] >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(keys) > 1 else np.zeros(len(at), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys[0][at].view(np.int64)), pa.array(second), pa.array(salt), pa.array(ids[at], mask=kind == 1)], names=["key", "key2", "salt", "id"])


_KEYED = "key long, key2 int, salt int, id long"


def _learned(rows: DataFrame, last: bool) -> DataFrame:
    """(id, known): the keys of each document that repeat, at the last length those that an earlier document has."""
    group = Window.partitionBy("key", "key2", "salt")
    if last:
        told = rows.withColumn("least", F.min("id").over(group)).where("salt <> 0 OR id > least")
    else:
        told = rows.withColumn("n", F.count("*").over(group)).where("id IS NOT NULL AND (salt <> 0 OR n > 1)")
    return told.groupBy("id").agg(F.collect_list("key").alias("known"))


def _copies(texts: DataFrame) -> DataFrame:
    """(id, copies): marks of the texts of each id that an earlier id has too."""
    marked = texts.where("text IS NOT NULL").select("id", F.sha2("text", 256).alias("mark"))
    least = marked.groupBy("mark").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    return salted_left_join(marked, least, ["mark"], "id").where("id > least").groupBy("id").agg(F.collect_set("mark").alias("copies"))


def _listed(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of keys of a batch in one array, and the row of each."""
    lists = b.column(column)
    return np.repeat(np.arange(b.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _known(doc: np.ndarray, keys: np.ndarray, owner: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether each key is in the list of its own document."""
    tag = lambda d, k: k ^ (d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.isin(tag(doc, keys), tag(owner, listed))


def drop_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, first: int = FIRST) -> DataFrame:
    """(key, n_words, n_removed, removed, kept): each text without the words of windows that stand in an earlier document.

    Words are separated by ASCII white space. A word goes where a window of ``window``
    words of its text covers it whose words also stand in a row with a smaller key;
    windows are judged on the texts as given. ``removed`` is an array of (start, length),
    starts counted from 0; ``kept`` holds the other words, joined by one space.

    A NULL or empty text has no words. A NULL key counts as larger than every other; rows
    with equal keys do not precede one another. A key is a whole number. Texts shorter than
    a window keep all words; an empty table gives an empty result; other columns do not
    matter. Keys of windows have 64 bits where they only choose candidates and 96 at the last
    length. A document's own keys are its one unbounded group: they grow with its text.
    """
    chain = levels(window, first)
    number = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    texts = df.select(number.alias("id"), F.col(key).alias("own"), F.col(text).alias("text"))
    copy = F.coalesce(F.array_contains("copies", F.when(F.col("copies").isNotNull(), F.sha2("text", 256))), F.lit(False)).alias("copy")
    # one exchange of the texts by id serves every join with them: all take the same columns
    dealt = texts.join(_copies(texts), "id", "left").select("id", "text", "own", copy)
    fresh = dealt.where(~F.col("copy"))
    kind = df.schema[key].dataType.simpleString()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = len(chain) > 1
        for b in slices(batches, 1):
            w = Words(b.column(1), second=not sampled)
            if sampled:
                keys = least_parts(w.keys(chain[0]), chain[1] - chain[0] + 1)
                at = np.flatnonzero(w.inside(chain[1]))
                at = at[np.r_[True, (keys[at][1:] != keys[at][:-1]) | (w.doc[at][1:] != w.doc[at][:-1])]] if len(at) else at
                found = [keys[at]]
            else:
                at = np.flatnonzero(w.inside(window))
                found = [w.keys(window, i)[at] for i in (0, 1)]
            yield _rows(b.column(0).to_numpy(zero_copy_only=False)[w.doc[at]], found, not sampled)

    def doubled(level: int) -> Callable:
        last = level == len(chain) - 1

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1):
                w = Words(b.column(1), second=last)
                owner, listed = _listed(b, 2)
                size, half = chain[level], chain[level - 1]
                at = np.flatnonzero(w.inside(size))
                shorter = w.keys(half)
                if level == 1:
                    good = _known(w.doc[at], least_parts(shorter, size - half + 1)[at], owner, listed)
                else:
                    good = _known(w.doc[at], shorter[at], owner, listed) & _known(w.doc[at], shorter[at + size - half], owner, listed)
                at = at[good]
                yield _rows(b.column(0).to_numpy(zero_copy_only=False)[w.doc[at]], [w.keys(size, i)[at] for i in range(1 + last)], last)

        return step

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            w = Words(b.column(1))
            owner, listed = _listed(b, 2)
            gone = np.zeros(len(w.doc) + 1, np.int64)
            whole = b.column(4).to_numpy(zero_copy_only=False) & (w.counts >= window)
            if len(listed):
                at = np.flatnonzero(w.inside(window))
                at = at[_known(w.doc[at], w.keys(window)[at], owner, listed)]
                np.add.at(gone, at, 1)
                np.subtract.at(gone, at + window, 1)
            gone = (np.cumsum(gone[:-1]) > 0) | whole[w.doc]
            removed = np.bincount(w.doc[gone], minlength=b.num_rows)
            left = w.flat.filter(pa.array(~gone)) if gone.any() else w.flat
            ends = np.r_[0, np.cumsum(w.counts - removed)]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left), " ")
            edge = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (w.doc[1:] == w.doc[:-1])]) if len(gone) else np.zeros(0, np.int64)
            stop = np.flatnonzero(gone & ~np.r_[gone[1:] & (w.doc[1:] == w.doc[:-1]), False]) if len(gone) else edge
            spans = pa.StructArray.from_arrays([pa.array(edge - w.starts[w.doc[edge]]), pa.array(stop - edge + 1)], names=["start", "length"])
            many = pa.array(np.r_[0, np.cumsum(np.bincount(w.doc[edge], minlength=b.num_rows))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(3), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(many, spans), kept],
                names=[key, "n_words", "n_removed", "removed", "kept"])

    rows = fresh.select("id", "text", "own").mapInArrow(start, _KEYED)
    for level in range(1, len(chain)):
        held = fresh.join(_learned(rows, False), "id").select("id", "text", "known", "own")
        rows = held.mapInArrow(doubled(level), _KEYED)
    held = dealt.join(_learned(rows, True), "id", "left").select("id", "text", "known", "own", "copy")
    return held.mapInArrow(finish, f"`{key}` {kind}, n_words long, n_removed long, removed array<struct<start:long,length:long>>, kept string")
