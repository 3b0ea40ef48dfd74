"""Metrics CSV of any size: many tasks a file, quoted line breaks and all.

One scan finds, in built-in functions, the input splits with lines that are no whole
record by themselves, a second takes the files' first lines. Files without such lines are read by
Spark's own CSV source, split by split. For the others a further scan finds what each split
does to the state "inside quotes", for either state at its start; composed in file order
that tells how each split begins. With it every split cuts its lines into records by
itself, and only records that cross a split are put together after an exchange.
"""

from __future__ import annotations

import csv
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The quoted kind comes first: the possessive repetition below keeps the first kind that matches, and the other matches nothing before any quote.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
#: A line that is one whole record, no quote within an unquoted field.
WHOLE = rf"^{_FIELD}(?:,{_FIELD})*+\s*$"
_PLAIN, _QUOTED = re.compile(r"[^,]*"), re.compile(r'[^"]*(?:""[^"]*)*')

#: What becomes of the characters of a header name; other characters stay. Fixed values.
HEADER_CHARACTERS = str.maketrans({"﻿": "", "(": "", ")": "", "$": "", "%": "pct", "/": "_", "-": "_", " ": "_"})


def normalize_header(name: str) -> str:
    """Trimmed, in lower case, its characters mapped by HEADER_CHARACTERS."""
    return name.strip().lower().translate(HEADER_CHARACTERS)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the line's end. A quote opens a field only at its start."""
    at, n = 0, len(line)
    while True:
        if inside:
            at = _QUOTED.match(line, at).end()
            if at >= n:
                return True
            at += 1  # the closing quote; what follows up to the comma is the field's too
        elif at < n and line[at] == '"':
            at, inside = at + 1, True
            continue
        at, inside = _PLAIN.match(line, at).end() + 1, False
        if at > n:
            return False


def _paths(files: list[str]) -> list[str]:
    """What the reader takes for the URIs that it gives."""
    return [urllib.parse.unquote(f) for f in files]


def _lines(spark: SparkSession, files: list[str] | str) -> DataFrame:
    return spark.read.text(files if isinstance(files, str) else _paths(files)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("row"))


def _splits(lines: DataFrame) -> list:
    """A row per input split: file, at, whether it has lines that are no whole record, and the number of its first line.

    The driver holds a row a split, as Spark's planner does. No line is kept in the aggregate: strings there would be sorted, all lines of a task.
    """
    odd = F.contains("value", F.lit('"')) & ~F.col("value").rlike(WHOLE)
    return lines.groupBy("file", "at").agg(F.max(odd).alias("odd"), F.min("row").alias("row")).collect()


def _heads(lines: DataFrame, splits: list) -> dict[str, str]:
    """The first line of each file."""
    first = [r["row"] for r in splits if r["at"] == 0]
    return {r["file"]: r["value"] for r in lines.where(F.col("row").isin(first)).select("file", "value").collect()} if first else {}


def _effects(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, bool, bool]]:
    """Of each split with quotes: whether it ends inside when begun outside, when begun inside, and whether the latter ever closes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["file", "at", "from_out", "from_in", "closes"]
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(names, [*now, *state], strict=True))])
        for b in batches:
            for file, at, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, at) != now:
                    if now:
                        yield done()
                    now, state = (file, at), [False, True, False]
                a = ends_inside(value, state[0])
                c = a if state[0] == state[1] else ends_inside(value, state[1])
                state = [a, c, state[2] or not c]
        if now:
            yield done()

    found = lines.where(F.contains("value", F.lit('"'))).select("file", "at", "value").mapInArrow(run, "file string, at long, from_out boolean, from_in boolean, closes boolean")
    return {(r["file"], r["at"]): (r["from_out"], r["from_in"], r["closes"]) for r in found.collect()}


def begun_inside(splits: list[tuple[str, int]], effects: dict) -> dict[tuple[str, int], int]:
    """For each split that begins inside quotes, the place of the split in which that record began."""
    out, file, inside, opened = {}, None, False, 0
    for f, at in sorted(splits):
        if f != file:
            file, inside = f, False
        if inside:
            out[f, at] = opened
        from_out, from_in, closes = effects.get((f, at), (False, True, False))
        if not inside or closes:
            opened = at
        inside = from_in if inside else from_out
    return out


def records(spark: SparkSession, files: list[str], splits: list[tuple[str, int]]) -> DataFrame:
    """(file, first, record): the records of the files, each whole, with the line breaks in it; ``first`` marks each file's first."""
    lines = _lines(spark, files)
    begun = begun_inside(splits, _effects(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, opened, parts, first = None, False, 0, [], False

        def piece(kind: int) -> tuple:
            return (now[0], first, kind, opened, now[1], "\n".join(parts))

        for b in batches:
            out = []
            for file, at, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, at) != now:
                    if parts:
                        out.append(piece(1))
                    now, parts = (file, at), []
                    inside, opened = now in begun, begun.get(now, at)
                    crossing, first = inside, at == 0
                if not inside:
                    crossing, opened = False, at
                parts.append(value)
                inside = ends_inside(value, inside)
                if not inside:
                    out.append(piece(1 if crossing else 0))
                    parts, first = [], first and not parts
            if out:
                yield _batch(out)
        if parts:
            yield _batch([piece(1)])

    made = lines.select("file", "at", "value").mapInArrow(run, "file string, first boolean, kind int, opened long, at long, record string")
    whole = made.where("kind = 0").select("file", "first", "record")
    if not begun:  # an open record at a file's end has no other part
        return whole.unionByName(made.where("kind = 1").select("file", "first", "record"))
    joined = made.where("kind = 1").groupBy("file", "opened").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("at", "record"))).alias("p"))
    return whole.unionByName(joined.select("file", "first", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "first", "kind", "opened", "at", "record"])


def _columns(header: str) -> list[str]:
    return [normalize_header(c) for c in next(csv.reader([header.lstrip("﻿")]))]


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    """Positions to names; of columns with one name the last counts."""
    place = {c: i for i, c in enumerate(columns)}
    return df.select(*[F.col(f"c{i}").alias(c) for c, i in place.items()])


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO1: all values as strings under normalised headers; an empty file or one without a header raises ValueError.

    Files of several exports may differ in their columns and in the columns' order: those
    that share a header are read together, then joined by name; a column that a file
    lacks is NULL there, of columns with the same normalised name the last counts. Rows may be
    shorter (NULL) or longer (the rest is left out) than the header; blank lines are none.
    A file of any size is read by many tasks, with line breaks inside quotes or without.
    """
    lines = _lines(spark, path)
    splits = _splits(lines)
    heads = _heads(lines, splits)
    odd = sorted({r["file"] for r in splits if r["odd"]})
    every = set(spark.read.text(path).inputFiles())
    if not every or len(heads) < len(every):
        raise ValueError("the CSV has no header")
    stitched = records(spark, odd, [(r["file"], r["at"]) for r in splits if r["file"] in {*odd}]) if odd else None
    if odd:
        heads |= {r["file"]: r["record"] for r in stitched.where("first").collect()}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, head in heads.items():
        if not head.strip("﻿\r "):
            raise ValueError("the CSV has no header")
        groups.setdefault(tuple(_columns(head)), []).append(file)
    out = None
    for columns, files in sorted(groups.items()):
        schema = ", ".join(f"c{i} string" for i in range(len(columns)))
        plain = [f for f in files if f not in {*odd}]
        parts = []
        if plain:
            parts.append(spark.read.schema(schema).option("header", True).option("escape", '"').csv(_paths(plain)))
        if len(plain) < len(files):
            mine = stitched.where(~F.col("first") & (F.trim("record") != ""))
            if len(groups) > 1:
                mine = mine.where(F.col("file").isin([f for f in files if f in {*odd}]))
            parts.append(mine.select(F.from_csv("record", schema, {"escape": '"'}).alias("r")).select("r.*"))
        for df in parts:
            df = _named(df, list(columns))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
