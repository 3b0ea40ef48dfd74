"""JSON documents whose size has no bound: the elements of one array of the top object, read piece by piece.

A file is one task, which holds a piece of it and one element: a state machine over brackets
and strings finds where elements end, whatever the pieces cut through. Elements come out as JSON
texts; values of other members that are asked for come with every element.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dealing import dealt_by_size
from .shared import located

#: Bytes that are read at a time.
PIECE = 1 << 20
_SPACE = " \t\n\r"
_STOP = re.compile(r'["\[\]{},:]')
_STRING_STOP = re.compile(r'["\\]')


class Broken(ValueError):
    """The text is no JSON object, or ends early."""


@dataclass
class Text:
    """A text that arrives in pieces; ``held`` from ``at`` on is not taken yet."""

    pieces: Iterator[str]
    held: str = ""
    at: int = 0

    def more(self) -> bool:
        new = next(self.pieces, "")
        self.held, self.at = self.held[self.at:] + new, 0
        return bool(new)

    def peek(self) -> str:
        """The next character that is no white space."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                raise Broken("the text ends early")

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise Broken(f"{wanted!r} expected")
        self.at += 1

    def value(self, kept: bool = True) -> str:
        """The next value as it stands; with ``kept`` False it is passed over, without being held."""
        self.peek()
        parts, depth, inside, scan = [], 0, False, self.at

        def given(end: int) -> str:
            if kept:
                parts.append(self.held[self.at:end])
            self.at = end
            return "".join(parts)

        while True:
            found = (_STRING_STOP if inside else _STOP).search(self.held, scan)
            if not found:
                given(len(self.held))
                if not self.more():
                    raise Broken("the text ends early")
                scan = 0
                continue
            c, scan = found.group(), found.end()
            if inside:
                if c == "\\":
                    if scan >= len(self.held):
                        given(len(self.held))
                        if not self.more():
                            raise Broken("the text ends early")
                        scan = 0
                    scan += 1
                    continue
                inside = False
                if not depth:
                    return given(scan)
            elif c == '"':
                inside = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                if not depth:
                    return given(scan - 1).strip(_SPACE)
                depth -= 1
                if not depth:
                    return given(scan)
            elif not depth and c == ",":
                return given(scan - 1).strip(_SPACE)


def members(text: Text) -> Iterator[str]:
    """The names of the top object's members; the value of each stands next and must be taken."""
    if text.peek() != "{":
        raise Broken("no JSON object")
    text.take("{")
    if text.peek() == "}":
        text.take("}")
    else:
        while True:
            name = json.loads(text.value())
            text.take(":")
            yield name
            if text.peek() == "}":
                text.take("}")
                break
            text.take(",")
    try:
        text.peek()
    except Broken:
        return
    raise Broken("something follows the object")


def elements(text: Text) -> Iterator[str]:
    """The elements of the array that stands next, each as it stands."""
    text.take("[")
    if text.peek() == "]":
        text.take("]")
        return
    while True:
        found = text.value()
        if not found:
            raise Broken("an element is missing")
        yield found
        if text.peek() == "]":
            text.take("]")
            return
        text.take(",")


def _open(path: str):
    store, place = located(path)
    return store.open_input_stream(place, compression=None)


def _pieces(path: str, size: int) -> Iterator[str]:
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    with _open(path) as f:
        while part := f.read(size):
            yield decoder.decode(part)
        yield decoder.decode(b"", True)


def parsed(pieces, array: str, side: str | None) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """(position, element, side, error) of one document; ``pieces`` gives its text anew at each call.

    Where the side member stands after the array, the document is read twice.
    """
    beside, known, position = None, side is None, 0
    try:
        text = Text(iter(pieces()))
        for name in members(text):
            if name == side:
                beside, known = text.value(), True
            elif name == array and text.peek() != "[":
                text.value(kept=False)
                yield 0, None, beside, f"the {array} field is no array"
                return
            elif name == array:
                if not known:
                    ahead = Text(iter(pieces()))
                    for other in members(ahead):
                        if other == side:
                            beside = ahead.value()
                        else:
                            ahead.value(kept=False)
                    known = True
                for e in elements(text):
                    yield position, e, beside, None
                    position += 1
            else:
                text.value(kept=False)
    except (Broken, UnicodeDecodeError, json.JSONDecodeError) as e:
        yield position, None, beside, f"{e}"


def read_elements(spark: SparkSession, path: str, array: str, side: str | None = None, piece: int = PIECE) -> DataFrame:
    """(file, position, element, side, error): the elements of the member ``array`` of each JSON file, as JSON texts.

    ``side`` is the JSON text of another member. A file that can't be read, is no JSON
    object or holds something else than an array there ends with a row that has the reason in ``error`` and no
    element; files without the member have no rows. Files are dealt by size, so that large ones lie in tasks of their own.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("path"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "position", "element", "side", "error"])

        for b in batches:
            for file in b.column(0).to_pylist():
                try:
                    for row in parsed(lambda: _pieces(file, piece), array, side):  # noqa: B023
                        rows.append((file, *row))
                        size += len(row[1] or "") + 200
                        if size > 1 << 22:
                            yield batch()
                            rows, size = [], 0
                except OSError as e:
                    rows.append((file, 0, None, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield batch()

    return dealt_by_size(listed).select("path").mapInArrow(run, "file string, position long, element string, side string, error string")
