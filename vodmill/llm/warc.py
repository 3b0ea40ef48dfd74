"""Operator 2: WARC archives as a PySpark Python data source.

Writing: each task writes its own gzip-per-record file; the commit writes a manifest of
the files of successful attempts with places where a reader may start, and beside each
file lies an index of its records' places and headers. Reading: a partition per manifest
range; archives from elsewhere (``.warc.gz``, ``.warc``) are cut into ranges that begin at
the next gzip member, plain ones are a partition each. Predicates on the record type,
digest, date, URI and record id are pushed down. With an index the reader takes the part of
it that belongs to its range, reads runs of wanted records at once and no others and,
where ``payload`` is false, opens no record at all; without one it tests the headers and
passes over blocks that fail.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from .common import materialize, salted_left_join, shared_dir

SCHEMA = (
    "record_id string, record_type string, date string, target_uri string, payload_digest string, refers_to string, "
    "payload_length long, content_length long, payload binary"
)
#: What the writer takes, in this order.
WRITE_SCHEMA = "record_id string, record_type string, date string, target_uri string, payload_digest string, refers_to string, payload binary"
MANIFEST = "_manifest.json"
INDEX = ".index"
#: Bytes of a run of wanted records that are read at once, and what a run may hold for each wanted byte.
RUN_BYTES, RUN_SHARE = 4 << 20, 1.2
#: Compressed bytes after which a reader's range ends at the next record.
RANGE_BYTES = 16 << 20
_FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length",
}


def _fs(path: str):
    """(filesystem, path) for a URI or a plain path; file systems are those of pyarrow."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """One WARC/1.1 record; ``response`` carries an HTTP message, ``revisit`` only its head."""
    body = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = head if row["record_type"] == "revisit" else head + body
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {clean(row['record_type'])}", f"WARC-Record-ID: <{clean(row['record_id'])}>", f"WARC-Date: {clean(row['date'])}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{clean(row['payload_digest'])}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{clean(row['refers_to'])}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"X-Payload-Length: {len(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    starts: list[int]
    size: int
    index: list[int]  # where each range's part of the index begins, and its end


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"  # a repeated attempt never meets another's file
        at, starts, lines, places = 0, [0], zlib.compressobj(6, zlib.DEFLATED, 31), [0]
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out, fs.open_output_stream(f"{base}/{name}{INDEX}", compression=None) as index:
            for b in iterator:
                for i in range(b.num_rows):
                    row = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}
                    whole = record(row)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(whole) + packer.flush()
                    if at - starts[-1] >= RANGE_BYTES:
                        starts.append(at)
                        index.write(lines.flush())
                        places.append(index.tell())
                        lines = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(data)
                    head = whole[:whole.index(b"\r\n\r\n") + 4].decode()
                    index.write(lines.compress(json.dumps([at, head]).encode() + b"\n"))
                    at += len(data)
            index.write(lines.flush())
            places.append(index.tell())
        return Written(name, starts, at, places)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        files = [{"name": m.name, "starts": m.starts, "size": m.size, "index": m.index} for m in messages if m]
        with fs.open_output_stream(f"{base}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{base}/{m.name}")
                fs.delete_file(f"{base}/{m.name}{INDEX}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int | None
    index: tuple[int, int] | None

    def __init__(self, file: str, start: int, end: int | None, index: tuple[int, int] | None = None):
        self.file, self.start, self.end, self.index = file, start, end, index


def runs_of(wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the reads that hold the wanted (start, end), in order: neighbours together while little else lies between."""
    out: list[list[int]] = []
    held = 0
    for a, b in wanted:
        if out and b - out[-1][0] <= min(RUN_BYTES, RUN_SHARE * (held + b - a)):
            out[-1][1], held = b, held + b - a
        else:
            out.append([a, b])
            held = b - a
    return [(a, b) for a, b in out]


def _next_member(stream, limit: int | None) -> int | None:
    """The place, from where ``stream`` stands, of the next gzip member that holds a record; None beyond ``limit``."""
    held, at = b"", 0
    while limit is None or at < limit:
        i = held.find(b"\x1f\x8b\x08")
        if i >= 0 and len(held) - i >= 1 << 16 or i >= 0 and not (more := stream.read(1 << 18)):
            try:
                if zlib.decompressobj(31).decompress(held[i:i + (1 << 16)], 5) == b"WARC/":
                    return at + i if limit is None or at + i < limit else None
            except zlib.error:
                pass
            held, at = held[i + 1:], at + i + 1
            continue
        if i < 0:
            more = stream.read(1 << 18)
            keep = held[-2:] if more else b""
            at += len(held) - len(keep)
            held = keep
        if not more:
            return None
        held += more
    return None


def _members(stream, limit: int | None) -> Iterator[Iterator[bytes]]:
    """The decompressed data of each gzip member that begins before ``limit`` bytes."""
    held, done = b"", 0
    while True:
        if not held and not (held := stream.read(1 << 18)):
            return
        if limit is not None and done >= limit:
            return
        while len(held) < 2 and (more := stream.read(1 << 18)):  # a read may end between the two bytes of the magic
            held += more
        if held[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip archive")
        unpack = zlib.decompressobj(31)

        def data():
            nonlocal held, done
            while True:
                n = len(held)
                out = unpack.decompress(held, 1 << 20)
                held = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                done += n - len(held)
                if out:
                    yield out
                if unpack.eof:
                    return
                if not held and not (held := stream.read(1 << 18)):
                    raise EOFError("archive ends inside a record")

        chunks = data()
        yield chunks
        for _ in chunks:  # what the caller left
            pass


def _plain(stream) -> Iterator[Iterator[bytes]]:
    """An archive without compression, as one member."""
    yield iter(lambda: stream.read(1 << 18), b"")


class Records:
    """The records of one member: a member may hold several."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def _more(self) -> bool:
        more = next(self.chunks, b"")
        self.held += more
        return bool(more)

    def header(self) -> dict | None:
        """The header fields of the next record, lower-cased; None at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not self._more():
                break
        if not self.held:
            return None
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self._more():
                raise ValueError("a record without a blank line after its header")
        head, self.held = self.held[:end], self.held[end + 4:]
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        return _fields(head.decode("utf-8", "replace"))

    def block(self, length: int, wanted: bool) -> bytes:
        """The ``length`` bytes of the block, or nothing where it is not ``wanted``."""
        parts, left = [], length
        while left:
            if not self.held and not self._more():
                raise EOFError("archive ends inside a record")
            part, self.held = self.held[:left], self.held[left:]
            left -= len(part)
            if wanted:
                parts.append(part)
        return b"".join(parts)


def _fields(head: str) -> dict:
    fields = {}
    for line in head.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Takes equality, membership and prefix tests of header columns; gives back the others."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _FIELDS and name != "payload_length" and isinstance(f, (EqualTo, In, StringStartsWith)):
                kind = "starts" if isinstance(f, StringStartsWith) else "in"
                self.tests.append((name, kind, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = _fs(self.path)
        if fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_file(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())
            return [
                Range(f"{base}/{x['name']}", a, b, i) for x in files if x["size"]
                for a, b, i in zip(x["starts"], [*x["starts"][1:], x["size"]], zip(x["index"], x["index"][1:], strict=False), strict=True)
            ] or [Range("", 0, 0)]
        info = fs.get_file_info(base)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        out = []
        for x in found:
            if x.type == pafs.FileType.File and x.path.endswith(".warc"):
                out.append(Range(x.path, 0, None))
            elif x.type == pafs.FileType.File and x.path.endswith(".warc.gz"):
                out += [Range(x.path, a, a + RANGE_BYTES) for a in range(0, x.size, RANGE_BYTES)]
        return out or [Range("", 0, 0)]

    def _row(self, fields: dict) -> dict | None:
        """The columns of a record's header; None where a pushed test fails."""
        row = {c: fields.get(h.lower()) for c, h in _FIELDS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        if any(row[c] is None or (not row[c].startswith(v[0]) if how == "starts" else row[c] not in v) for c, how, v in self.tests):
            return None
        return row

    def _out(self, row: dict, fields: dict, body: bytes | None) -> tuple:
        size = int(row["payload_length"]) if row["payload_length"] else None if body is None else len(body)
        length = int(fields.get("content-length", 0))
        return row["record_id"], row["record_type"], row["date"], row["target_uri"], row["payload_digest"], row["refers_to"], size, length, body

    def _records(self, chunks: Iterator[bytes]) -> Iterator[tuple]:
        records = Records(chunks)
        while (fields := records.header()) is not None:
            row = self._row(fields)
            wanted = row is not None and self.payload and row["record_type"] != "revisit"
            block = records.block(int(fields.get("content-length", 0)), wanted)
            if row is not None:
                http = fields.get("content-type", "").startswith("application/http")
                yield self._out(row, fields, (block.partition(b"\r\n\r\n")[2] if http else block) if wanted else None)

    def _bytes(self, f, start: int, end: int) -> bytes:
        f.seek(start)
        return f.read(end - start)

    def _indexed(self, fs, partition: Range) -> Iterator[tuple]:
        """The records that pass, by their places in the range's part of the index; only their runs are read."""
        with fs.open_input_file(f"{partition.file}{INDEX}") as lines:
            listed = [json.loads(x) for x in zlib.decompressobj(31).decompress(self._bytes(lines, *partition.index)).splitlines()]
        found = []
        for (place, head), end in zip(listed, [*(p for p, _ in listed[1:]), partition.end], strict=True):
            fields = _fields(head)
            row = self._row(fields)
            if row is not None:
                found.append((place, end, row, fields, self.payload and row["record_type"] != "revisit"))
        runs = iter(runs_of([x[:2] for x in found if x[4]]))
        with fs.open_input_file(partition.file) as f:
            start = stop = 0
            held = b""
            for place, end, row, fields, wanted in found:
                if not wanted:
                    yield self._out(row, fields, None)
                    continue
                if place >= stop:
                    start, stop = next(runs)
                    held = self._bytes(f, start, stop)
                data = zlib.decompressobj(31).decompress(memoryview(held)[place - start:end - start])
                yield from self._records(iter([data]))

    def read(self, partition: Range):
        if not partition.file:
            return
        from pyarrow import fs as pafs

        fs, _ = _fs(self.path)
        if (self.tests or not self.payload) and partition.index and fs.get_file_info(f"{partition.file}{INDEX}").type == pafs.FileType.File:
            yield from self._indexed(fs, partition)
            return
        with fs.open_input_file(partition.file) as f:
            f.seek(partition.start)
            if partition.file.endswith(".warc"):
                yield from self._records(next(_plain(f)))
                return
            limit = None if partition.end is None else partition.end - partition.start
            if partition.start:  # a range of an archive from elsewhere may begin inside a member
                ahead = _next_member(f, limit)
                if ahead is None:
                    return
                f.seek(partition.start + ahead)
                limit = None if limit is None else limit - ahead
            for chunks in _members(f, limit):
                yield from self._records(chunks)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)``; ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Records to write. Of rows with equal payloads of at least ``min_revisit_bytes`` the largest key is the response.

    Payload: the html as UTF-8, NULL as empty. Only digests that occur twice or more are
    joined, salted, so a payload that fills a third of the table is no hot key. Rows that
    repeat the largest key are each a response; a NULL key is smaller than any other and,
    alone with its payload, a response. An empty table gives no records.
    """
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), raw.alias("payload"), F.sha1(raw).alias("sha"))
    groups = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("k").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1").select("sha", "first"), "payloads")
    out = salted_left_join(rows, groups, ["sha"], "k")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("k"))
    # base32 of the 160-bit digest, five bits a letter
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring("sha", 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    code = F.concat(*[F.substring(F.lit(letters), F.conv(F.substring(F.col("bits"), 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)])
    return out.withColumn("bits", bits).select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("k").cast("string"), F.lit(""))).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("u").alias("target_uri"), code.alias("payload_digest"),
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"), "payload",
    )


def write_archive(records: DataFrame, path: str) -> None:
    """Writes records (the columns of WRITE_SCHEMA) below ``path``: a file per task, its index, and the manifest.

    A NULL payload is empty, a NULL URI or reference is left out; repeated rows are records each; an
    empty table writes an archive without records.
    """
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path`` with the columns of SCHEMA; without ``payload`` no body is read.

    Revisits have no payload. A header that a record lacks is NULL; an archive without records gives no rows.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads every record back.

    NULL and repeated ``page_id`` as in ``with_revisits``; an empty table gives no rows.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archive(with_revisits(pages), path)
    return read_archive(pages.sparkSession, path)
