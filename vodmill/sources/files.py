"""File sources and sinks: metrics CSV, report JSON, captions, candidate responses, media folders, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vodmill.functions.candidates import seconds_to_timestamp

from .dealing import dealt_by_size
from .json_arrays import read_elements
from .quoted_csv import normalize_header, read_metrics_csv  # noqa: F401
from .shared import located, scratch, stored

#: Media suffixes and files of a structured pass.
VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "webm", "avi", "m4v")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff", "heic")
#: Tasks at most that list a level of folders, and files of a batch of theirs.
LISTING_TASKS, LISTED_ROWS = 1024, 1 << 16


def _told(df: DataFrame) -> DataFrame:
    """Elements whose file reads well; a file's error ends the job."""
    said = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error")).cast("string")).otherwise(F.col("element"))
    return df.withColumn("element", said).where("element IS NOT NULL")


def read_report_json(spark: SparkSession, path: str) -> DataFrame:
    """IO2: a map of header name to value (as text) per report row, with its file and position.

    A report of any size is read element by element. Of headers with one name the last
    counts. A file that is no JSON object, or whose rows are no array, raises.
    """
    rows = _told(read_elements(spark, path, "rows", "columnHeaders"))
    rows = rows.select("file", F.col("position").cast("int").alias("position"), F.from_json("side", "array<struct<name:string>>")["name"].alias("names"), F.from_json("element", "array<string>").alias("r"))
    pairs = F.arrays_zip("names", F.slice("r", F.lit(1), F.size("names")).alias("values"))
    last = F.filter(pairs, lambda e, i: F.array_position(F.slice("names", i + 2, F.size("names")), e["names"]) == 0)
    repeated = F.size(F.array_distinct("names")) < F.size("names")
    return rows.select("file", "position", F.map_from_entries(F.when(repeated, last).otherwise(pairs)).alias("record"))


def _seconds_part(event: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(event, path).try_cast("double"), F.lit(0.0)).cast("long")


def caption_event(event: Column, number: Column, collapse: bool = True) -> Column:
    """struct<event,start_ms,end_ms,text> of one event's JSON text; a text without anything but white space is empty."""
    pieces = F.transform(F.from_json(F.get_json_object(event, "$.segs"), "array<string>"), lambda s: F.get_json_object(s, "$.utf8"))
    if collapse:
        pieces = F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    shown = F.filter(pieces, lambda s: s.isNotNull() & (F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))
    start = F.greatest(_seconds_part(event, "$.tStartMs"), F.lit(0))
    return F.struct(number.alias("event"), start.alias("start_ms"), (start + F.greatest(_seconds_part(event, "$.dDurationMs"), F.lit(0))).alias("end_ms"), F.coalesce(F.array_join(shown, " "), F.lit("")).alias("text"))


def odd_time(event: Column) -> Column:
    """Whether an event that shows a text has a time that is no number."""
    odd = lambda p: F.coalesce(F.get_json_object(event, p), F.lit("")).rlike(r"\S") & F.get_json_object(event, p).try_cast("double").isNull()
    return (odd("$.tStartMs") | odd("$.dDurationMs")) & (caption_event(event, F.lit(0))["text"] != "")


def caption_segments(json: Column, collapse: bool = True) -> Column:
    """array<struct<event,start_ms,end_ms,text>> of a JSON3 caption text that is one value.

    Events and segments that are no objects are skipped; NULL where ``events`` is no array.
    """
    events = F.from_json(F.get_json_object(json, "$.events"), "array<string>")
    return F.filter(F.transform(events, lambda e, i: caption_event(e, i, collapse)), lambda x: x["text"] != "")


def _caption_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, event, element, error) of caption files of any size."""
    df = read_elements(spark, path, "events")
    late = F.when(F.col("element").isNotNull() & odd_time(F.col("element")), "an event has a time that is no number")
    return df.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), F.col("position").cast("int").alias("event"), "element", F.coalesce("error", late).alias("error"))


def read_caption_json3(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """IO3: caption segments of each file in event order; a file of any size is read event by event.

    A file that can't be read raises; with ``strict=False`` it gives no rows, and ``caption_failures`` names it.
    """
    events = _caption_events(spark, path)
    events = _told(events) if strict else events.join(caption_failures(spark, path).select("file"), "file", "left_anti")
    return events.select("file", caption_event(F.col("element"), F.col("event")).alias("s")).select("file", "s.*").where("text <> ''")


def caption_failures(spark: SparkSession, path: str) -> DataFrame:
    """IO3: (file, error) of the caption files that can't be read."""
    return _caption_events(spark, path).where("error IS NOT NULL").groupBy("file").agg(F.min_by("error", "event").alias("error"))


def _caption_line(segment: Column) -> Column:
    t = F.floor(segment["start_ms"] / 1000)
    stamp = F.when(t >= 3600, seconds_to_timestamp(t)).otherwise(F.format_string("%02d:%02d", F.floor(t / 60), t % 60))
    return F.concat(stamp, F.lit(" "), segment["text"])


def read_caption_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO4: (file, event, line): a line '[HH:]MM:SS text' per event of caption files of any size; inner white space stays."""
    events = _told(_caption_events(spark, path)).select("file", caption_event(F.col("element"), F.col("event"), False).alias("s"))
    return events.where("s.text <> ''").select("file", "s.event", _caption_line(F.col("s")).alias("line"))


def caption_plain_text(json: Column) -> Column:
    """IO4 of a caption text that is one value: the lines of ``read_caption_lines`` in event order."""
    return F.array_join(F.transform(caption_segments(json, False), _caption_line), "\n")


def media_rows(df: DataFrame, root: str) -> DataFrame:
    """Media among (path, length, modified_ns, ...): kind by suffix, path relative to the root; other files go."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin(*VIDEO_SUFFIXES), "video").when(suffix.isin(*IMAGE_SUFFIXES), "image")
    bare = lambda c: F.regexp_replace(c, r"^[a-z]+:/+|^/+", "")
    rel = F.substring(bare(F.col("path")), F.length(bare(F.lit(root.rstrip("/")))) + 2, F.length("path"))
    rest = [c for c in df.columns if c not in ("path", "length", "modified_ns")]
    return df.select(rel.alias("source_path"), kind.alias("media_kind"), F.col("length").alias("size_bytes"), F.col("modified_ns").alias("source_modified_ns"), *rest).where("media_kind IS NOT NULL")


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified_ns) of every file below the folder ``root``, empty and hidden ones too.

    Tasks list the folders, a level at a time, and write what they find; the driver holds no list
    of files. A folder is listed by one task. What is gone meanwhile has no rows.
    """
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for folder in b.column(0).to_pylist():
                store, place = located(folder)
                found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
                for at in range(0, len(found), LISTED_ROWS):
                    rows = [(f"{folder}/{x.base_name}", x.type == fs.FileType.Directory, x.size, x.mtime_ns) for x in found[at:at + LISTED_ROWS] if x.type in (fs.FileType.File, fs.FileType.Directory)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["path", "folder", "length", "modified_ns"])

    schema, places = "path string, folder boolean, length long, modified_ns long", []
    level = spark.createDataFrame([(root,)], "path string").coalesce(1)
    while True:
        places.append(scratch(spark, "listing"))
        level.mapInArrow(run, schema).write.parquet(places[-1])
        folders = spark.read.schema(schema).parquet(places[-1]).where("folder").select("path")
        if not (n := folders.count()):
            break
        level = folders.repartition(min(n, LISTING_TASKS))
    return spark.read.schema(schema).parquet(*places).where("NOT folder").drop("folder")


def scan_media(spark: SparkSession, root: str) -> DataFrame:
    """IO5: media files below ``root``, listed without reading their content; ``path`` is the whole path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()
    found = files_below(spark, root).withColumn("full_path", F.col("path"))
    return media_rows(found, root).withColumnRenamed("full_path", "path")


def checksum(path: str, piece: int) -> tuple[str | None, str | None]:
    """(SHA-256, None) of a file, or (None, why it can't be read). A lack of memory or handles is the task's, which fails and is tried again."""
    import errno
    import hashlib

    digest = hashlib.sha256()
    try:
        store, place = located(path)
        with store.open_input_stream(place, compression=None) as f:
            while part := f.read(piece):
                digest.update(part)
    except Exception as e:  # noqa: BLE001  one bad file is an outcome, not the end of the job
        if isinstance(e, MemoryError) or getattr(e, "errno", None) in (errno.EMFILE, errno.ENFILE, errno.ENOMEM):
            raise
        return None, f"{type(e).__name__}: {e}"
    return digest.hexdigest(), None


def with_checksums(media: DataFrame, piece: int = 4 << 20) -> DataFrame:
    """IO5: adds ``checksum_sha256`` and ``error`` by reading each file at ``path`` in pieces.

    Files are dealt over tasks by their bytes, longest first. A recording of any length
    takes ``piece`` bytes of memory. A file that can't be read has
    a NULL checksum and the reason in ``error``, and stops no other; where its task lacks memory or
    handles, the task fails and is tried again.
    """
    names = [f for f in media.schema if f.name not in ("checksum_sha256", "error")]
    schema = T.StructType([*names, T.StructField("checksum_sha256", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [checksum(path, piece) for path in b.column("path").to_pylist()]
            sums, errors = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in names], pa.array(sums, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    # dealing looks at the list several times, and each time all files would be listed and opened anew
    dealt = dealt_by_size(stored(media.select(*[f.name for f in names]), "media"), size="size_bytes")
    return dealt.mapInArrow(run, schema)


_EVIDENCE = "array<struct<timestamp:string,seconds:bigint,text:string>>"
CANDIDATE = (
    f"struct<title:string,start_seconds:bigint,end_seconds:bigint,start_timestamp:string,end_timestamp:string,duration_seconds:bigint,primary_pillar:string,"
    f"tags:array<string>,transcript_excerpt:string,transcript_evidence:{_EVIDENCE},scores:map<string,int>>"
)


def parse_candidate_response(text: Column) -> Column:
    """IO6: the candidates of a model response: code fences go, a single ``candidate`` counts as a list of one."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    j = F.from_json(bare, f"stream_id string, source_video_id string, candidate {CANDIDATE}, candidates array<{CANDIDATE}>")
    return F.coalesce(j["candidates"], F.when(j["candidate"].isNotNull(), F.array(j["candidate"])))


def read_candidate_responses(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return doc.select("file", F.posexplode(parse_candidate_response(F.col("value"))).alias("position", "c")).select("file", (F.col("position") + 1).alias("candidate_rank"), "c.*")


def export_candidates(df: DataFrame, path: str, kind: str = "json") -> None:
    """IO8: JSON lines, or CSV with arrays joined by '|'."""
    if kind == "json":
        df.write.json(path)
        return
    flat = [F.array_join(f.name, "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)
