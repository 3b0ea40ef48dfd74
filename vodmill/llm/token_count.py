"""Operator 6: token counts, with overlap resynchronisation for huge documents.

A pre-token of this vocabulary never crosses white space, and the library encodes each
one alone, so counts of pre-tokens add up. Texts above ``chunk`` characters go to the
library in overlapping chunks, which are spliced where both agree. Of shorter ones those
in Latin script are counted by looking pre-tokens up in a bounded memory of library
results, the others go to the library whole.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Characters above which a text is encoded in chunks, and the first width of their overlap.
CHUNK, OVERLAP = 8_192, 256

class Counter:
    """Counts tokens as ``tokenizers`` does for one vocabulary file, without special tokens added."""

    #: Below this code point, Python and the library agree on letters, digits, case and NFC.
    PLAIN = "ɐ"
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, remembered: int = 400_000):
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(self.PATTERN).findall
        pre = json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False)
        norm = json.dumps(spec.get("normalizer"))
        #: The short way is only taken for the pre-tokeniser it was written for.
        self.known = json.dumps(self.PATTERN)[1:-1] in pre and "NFC" in norm and "Lowercase" in norm
        self.chunk, self.overlap, self.remembered = chunk, overlap, remembered
        self.memory: dict[str, int] = {}
        self.splices = self.widened = 0

    def one(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def _learn(self, new: list[str]) -> None:
        """Counts of unseen pre-tokens, many in one call to the library."""
        for i in range(0, len(new), 2_000):
            part = new[i:i + 2_000]
            ids = self.library.encode(" ".join(part), add_special_tokens=False).word_ids
            counts = [0] * len(part)
            if ids and None not in ids and ids[-1] == len(part) - 1:
                for k in ids:
                    counts[k] += 1
            else:
                counts = [self.one(x) for x in part]
            self.memory.update(zip(part, counts, strict=True))

    def plain(self, text: str) -> bool:
        if not self.known or any(s in text for s in self.special):
            return False
        return text.isascii() or max(text) < self.PLAIN and unicodedata.is_normalized("NFC", text)

    def batch(self, texts: list[str]) -> list[int]:
        out: list[int | None] = []
        words: list[list[str] | None] = []
        for t in texts:
            if len(t) > self.chunk:
                words.append(None)
                out.append(self.spliced(t))
            elif self.plain(t):
                words.append(self.split(t.lower()))
                out.append(None)
            else:
                words.append(None)
                out.append(self.one(t))
        if len(self.memory) > self.remembered:
            self.memory.clear()
        unseen = set().union(*[w for w in words if w]) - self.memory.keys()
        if unseen:
            self._learn(list(unseen))
        get = self.memory.__getitem__
        return [n if w is None else sum(map(get, w)) for n, w in zip(out, words, strict=True)]

    def spliced(self, text: str) -> int:
        """Encodes overlapping chunks with offsets and splices them at stable boundaries.

        A boundary is stable where a token starts at the same place in both chunks, white
        space stands before it (no pre-token, special token, composition or case rule
        reaches across) and both chunks agree on every token from there to the end of
        the overlap. Where an overlap has none, it is widened, at last to the rest of the text.
        """
        total, skip = 0, 0  # tokens before text position skip are counted already
        start, end = 0, min(len(text), self.chunk)
        ids, places = self._chunk(text, start, end)
        while end < len(text):
            width = self.overlap
            while True:
                begin = max(start, end - width)
                beyond = min(len(text), begin + max(self.chunk, 2 * width))
                next_ids, next_places = self._chunk(text, begin, beyond)
                at = self._common(text, ids, places, next_ids, next_places, begin, end, skip)
                if at is not None:
                    total += sum(skip <= p < at for p in places)
                    skip, start, end, ids, places = at, begin, beyond, next_ids, next_places
                    self.splices += 1
                    break
                if begin == start:  # no stable boundary in this chunk at all: take it longer
                    end = min(len(text), start + 2 * (end - start))
                    ids, places = self._chunk(text, start, end)
                    break
                width *= 2
                self.widened += 1
        return total + sum(p >= skip for p in places)

    def _chunk(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """(ids, places in the text) of a chunk's tokens."""
        enc = self.library.encode(text[start:end], add_special_tokens=False)
        return enc.ids, [a + start for a, _ in enc.offsets]

    @staticmethod
    def _common(text: str, ids: list[int], places: list[int], next_ids: list[int], next_places: list[int], begin: int, end: int, skip: int) -> int | None:
        first = {p: i for i, p in enumerate(places)}
        for j, p in enumerate(next_places):
            if p >= end:
                return None
            if p <= max(begin, skip) or p not in first or not text[p - 1].isspace() or unicodedata.combining(text[p]):
                continue
            # tokens up to the last white space before the end of the first chunk must agree
            i, k = first[p], j
            last = next((q for q in range(end - 1, p, -1) if text[q].isspace()), p)
            while i < len(ids) and places[i] < last:
                if k >= len(next_ids) or ids[i] != next_ids[k]:
                    break
                i, k = i + 1, k + 1
            else:
                return p
        return None


@functools.lru_cache(maxsize=2)
def counter_for(path: str, chunk: int) -> Counter:
    """A worker keeps its counter, and what it remembers, from task to task."""
    return Counter(path, chunk)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", chunk: int = CHUNK) -> DataFrame:
    """Adds ``out``: the token count of each whole text; a NULL or empty text counts 0.

    Rows are independent; other columns pass through, ``out`` is replaced where it exists.
    ``path`` is the vocabulary file, which every worker must be able to read.
    """

    short_batches(df.sparkSession)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_for(path, chunk)
        for s in texts:
            yield pd.Series(counter.batch(["" if t is None else t for t in s]), dtype="int64")

    return df.withColumn(out, count(F.col(text)))
