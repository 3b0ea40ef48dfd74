"""Small cases of every training-data operator: NULLs, empty and long texts, ties, repeats, empty tables, clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vodmill.llm import ann, common, html_text, jaccard, langid, packing, quality, sharding, sp_fst, token_count, warc
from vodmill.llm.components import components

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b c d e"), (6, "a b c d e"), (6, "a b c d e"), (7, "x " * 3000), (8, "été naïve\nété naïve\n日本 | * #"),
    (None, "no id here"), (9, "l1 w.\nl1 w.\n\nl2 w."), (10, "y" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# 1 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("shards", "cells"), [(8, 4096), (3, 4)])
def test_shards_hold_equal_bytes_and_gapless_slots(spark, shards, cells):
    rows = [(i * 7 % 1009, "t" * (i % 50)) for i in range(1009)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.histogram_shards(df, shards=shards, cells=cells).toPandas().sort_values("doc_id")
    size = out["size"].to_numpy()
    before = np.r_[0, np.cumsum(size)[:-1]]
    assert (out["shard"].to_numpy() == before * shards // size.sum()).all()
    for _, g in out.groupby("shard"):
        assert list(g["slot"]) == list(range(len(g)))


def test_shards_cut_inside_a_hot_key(spark):
    df = spark.createDataFrame([(5, f"{i:04d}") for i in range(800)] + [(None, None)], "doc_id long, text string")
    out = sharding.histogram_shards(df, shards=8).toPandas()
    assert len(out) == 801
    assert out.groupby("shard")["size"].sum().max() - out.groupby("shard")["size"].sum().min() <= 10
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_shards_cut_among_equal_rows(spark):
    df = spark.createDataFrame([(5, "same")] * 800 + [(i, f"{i}") for i in range(8)], "doc_id long, text string").repartition(5)
    out = sharding.histogram_shards(df, shards=8).toPandas()
    assert Counter(zip(out.doc_id, out.text, strict=True)) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    held = out.groupby("shard")["size"].sum()
    assert len(held) == 8 and held.max() - held.min() <= 10
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    hot = spark.createDataFrame([(5, "t" * (i % 7) + str(i)) for i in range(1500)] + [(6, "t" * (i % 5) + str(i)) for i in range(900)], "doc_id long, text string")
    held = sharding.histogram_shards(hot, shards=8, cells=64).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert len(held) == 8 and held.max() - held.min() <= 22
    only = sharding.histogram_shards(spark.createDataFrame([(None, None)] * 64, "doc_id long, text string"), shards=8)
    assert sorted(r["count"] for r in only.groupBy("shard").count().collect()) == [8] * 8


def test_shards_edge_cases(spark, docs):
    out = sharding.histogram_shards(docs.withColumn("shard", F.lit("mine")).withColumn("k", F.lit(1)), shards=4)
    got = out.toPandas()
    assert len(got) == len(TEXTS) and set(got.columns) == {"doc_id", "text", "k", "slot", "shard", "size"}
    assert got[got.text.isna()]["size"].tolist() == [1]
    assert sharding.histogram_shards(empty(spark)).count() == 0


def test_shards_with_tolerance_stay_near_equal(spark):
    df = spark.createDataFrame([(i, "x" * 9) for i in range(4000)], "doc_id long, text string")
    got = sharding.histogram_shards(df, shards=4, tolerance=0.05, cells=64, buckets_per_shard=1).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()
    assert got.s.sum() == 40000 and got.s.max() <= 10000 * 1.06 and len(got) == 4


# 2 -----------------------------------------------------------------------------------------------------------------

PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u\n4", ""), (5, "u5", "é" * 70000), (9, "u9", "<p>a</p>")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    path = f"{common.shared_dir(spark)}/w1"
    warc.write_archive(warc.with_revisits(df), path)
    got = {r["record_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == 6
    assert (got["urn:page:9"]["record_type"], got["urn:page:1"]["refers_to"], got["urn:page:2"]["refers_to"]) == ("response", "urn:page:9", "urn:page:9")
    assert got["urn:page:3"]["refers_to"] == "urn:page:4" and got["urn:page:4"]["record_type"] == "response"
    for i, _, h in PAGES:
        r, body = got[f"urn:page:{i}"], (h or "").encode()
        assert (r["payload_digest"], r["payload_length"]) == (warc.digest(body), len(body))
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == body
    # pushed-down predicates and payload skipping give the same rows
    some = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:page:1", "urn:page:2", "urn:page:3"]
    assert warc.read_archive(spark, path).where("target_uri LIKE 'u5%'").select("payload_length").collect()[0][0] == 140000


def test_warc_smaller_payloads_stay_responses_and_empty_table(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["record_id"]: r["record_type"] for r in warc.with_revisits(df, min_revisit_bytes=1).collect()}
    assert got["urn:page:3"] == got["urn:page:4"] == "response" and got["urn:page:1"] == "revisit"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reads_ranges(spark, monkeypatch):
    import gzip

    path = f"{common.shared_dir(spark)}/w2"
    df = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("html")).coalesce(1)
    warc.write_archive(warc.with_revisits(df), path)
    reader = warc.WarcReader({"path": path})
    whole = list(reader.read(reader.partitions()[0]))
    part = reader.partitions()[0]
    raw = open(part.file, "rb").read()
    starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", raw)]
    cut = next(s for s in starts if s > len(raw) // 2 and gzip.decompress(raw[:s]))
    halves = [*reader.read(warc.Range(part.file, 0, cut)), *reader.read(warc.Range(part.file, cut, len(raw)))]
    assert halves == whole and len(whole) == 200


def test_warc_reads_runs_of_wanted_records_only(spark, monkeypatch):
    """Bytes read: 1.2 times those of the wanted records at most; where all pass, those of the file, once."""
    import glob
    import json
    import os

    from pyspark.sql.datasource import In, StringStartsWith

    monkeypatch.setattr(warc, "RANGE_BYTES", 60_000)
    rng = np.random.default_rng(2)
    path = f"{common.shared_dir(spark)}/w-runs"
    rows = [(i, f"u{i % 3}", rng.integers(0, 1 << 60, 40 + i % 50).astype(str).tolist()) for i in range(900)]
    df = spark.createDataFrame([(i, u, " ".join(h)) for i, u, h in rows], "page_id long, url string, html string").coalesce(1)
    writer = warc.WarcWriter(path)
    made = warc.with_revisits(df).select(*[c.split()[0] for c in warc.WRITE_SCHEMA.split(", ")]).toArrow()
    writer.commit([writer.write(iter(made.to_batches()))])
    (file,) = glob.glob(f"{path}/*.warc.gz")
    assert len(json.load(open(f"{path}/_manifest.json"))[0]["starts"]) > 3
    whole = [r for reader in [warc.WarcReader({"path": path})] for p in reader.partitions() for r in reader.read(p)]
    assert len(whole) == 900

    def reading(*filters):
        reader, seen = warc.WarcReader({"path": path}), []
        assert list(reader.pushFilters(filters)) == []
        take = reader._bytes
        reader._bytes = lambda f, a, b: (seen.append(b - a), take(f, a, b))[1]
        parts = reader.partitions()
        got = [r for p in parts for r in reader.read(p)]
        return got, sum(seen) - sum(p.index[1] - p.index[0] for p in parts), len(seen) - len(parts)

    got, read, reads = reading(StringStartsWith(("target_uri",), "u"))
    assert got == whole and read == os.path.getsize(file) and reads < 40
    sizes = dict(zip([r[0] for r in whole], np.diff([*sorted(x[0] for x in index_of(f"{file}.index")), os.path.getsize(file)]).tolist(), strict=True))
    for ids in ([5, 6, 7, 300], list(range(0, 900, 2)), list(range(0, 900, 97)), []):
        names = tuple(f"urn:page:{i}" for i in ids)
        got, read, reads = reading(In(("record_id",), names))
        assert got == [r for r in whole if r[0] in names] and read <= 1.2 * sum(sizes[n] for n in names) and reads <= len(ids)


def index_of(file):
    import json

    raw, out = open(file, "rb").read(), []
    while raw:
        unpack = zlib.decompressobj(31)
        out += [json.loads(x) for x in unpack.decompress(raw).splitlines()]
        raw = unpack.unused_data
    return out


@pytest.mark.parametrize("short", [0, 1, 2])
def test_warc_record_ends_just_before_the_end_of_a_read(short):
    import gzip
    import io

    def member(size):
        # stored, not compressed: a gzip head of 10 bytes, 5 a block of 65,535 bytes at most, and 8 at the end
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(b"x" * size) + packer.flush()

    end = 2**18 - short
    size = next(n for n in range(end - 100, end) if len(member(n)) == end)
    raw = member(size) + gzip.compress(b"next")
    assert [b"".join(chunks) for chunks in warc._members(io.BytesIO(raw), None)] == [b"x" * size, b"next"]
    with pytest.raises(ValueError, match="gzip archive"):
        list(warc._members(io.BytesIO(member(10) + b"\x1f"), None))


def foreign(i, body, kind="response"):
    head = f"HTTP/1.1 200 OK\r\nX: {i}\r\n\r\n".encode()
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{i}>", f"WARC-Target-URI: http://h/{i}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(head + body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + head + body + b"\r\n\r\n"


def test_warc_archives_from_elsewhere(spark, monkeypatch, tmp_path):
    """Several records in a member, plain archives, ranges that begin anywhere, and broken records."""
    import gzip

    rng = np.random.default_rng(0)
    bodies = [rng.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 3000, 60)]
    records = [foreign(i, b) for i, b in enumerate(bodies)]
    want = {f"urn:x:{i}": b for i, b in enumerate(bodies)}
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "some.warc.gz").write_bytes(b"".join(gzip.compress(b"".join(records[i:i + 7])) for i in range(0, 60, 7)))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    for name in ("one.warc.gz", "some.warc.gz", "each.warc.gz", "plain.warc"):
        for size in (16 << 20, 5000, 317):
            monkeypatch.setattr(warc, "RANGE_BYTES", size)
            reader = warc.WarcReader({"path": str(tmp_path / name)})
            got = [r for part in reader.partitions() for r in reader.read(part)]
            assert len(got) == 60 and {r[0]: r[8] for r in got} == want, (name, size)
    got = warc.read_archive(spark, str(tmp_path)).groupBy("record_id").count().collect()
    assert len(got) == 60 and all(r["count"] == 4 for r in got)
    assert warc.read_archive(spark, str(tmp_path / "one.warc.gz"), payload=False).where("record_id = 'urn:x:7'").count() == 1
    whole = gzip.compress(records[0]) + gzip.compress(records[1])
    for cut in range(0, len(whole), 97):
        at = warc._next_member(__import__("io").BytesIO(whole[cut:]), None)
        assert (None if at is None else at + cut) == next((s for s in (0, len(gzip.compress(records[0]))) if s >= cut), None)
    for bad, said in ((b"WARC/1.0\r\nno blank line", "blank line"), (b"HTTP/1.0 200\r\n\r\n", "not a WARC record"), (records[0][:-40], "inside a record")):
        with pytest.raises((ValueError, EOFError), match=said):
            list(warc.WarcReader({"path": ""})._records(iter([bad])))


def test_warc_index_opens_only_wanted_records(spark, monkeypatch):
    path = f"{common.shared_dir(spark)}/w3"
    df = spark.createDataFrame([*PAGES, (None, "u7", "<p>a</p>")], "page_id long, url string, html string")
    warc.write_archive(warc.with_revisits(df), path)
    opened = []
    records = warc.WarcReader._records
    monkeypatch.setattr(warc.WarcReader, "_records", lambda self, chunks: (opened.append(1), records(self, chunks))[1])
    for payload, tests, rows, unpacked in (("true", [("target_uri", "starts", ("u5",))], 1, 1), ("false", [], 7, 0), ("true", [("record_type", "in", ("revisit",))], 4, 0)):
        opened.clear()
        reader = warc.WarcReader({"path": path, "payload": payload})
        reader.tests = tests
        got = [r for part in reader.partitions() for r in reader.read(part)]
        assert (len(got), len(opened)) == (rows, unpacked)
        whole = warc.WarcReader({"path": path})
        assert {r[:8] for r in got} <= {r[:8] for part in whole.partitions() for r in whole.read(part)}


# 3 -----------------------------------------------------------------------------------------------------------------


def brute(rows, k=10):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[np.flatnonzero(ids == i)[0]]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    rows = [(i, (x[i] / np.linalg.norm(x[i])).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("id") % 100 == 0).toPandas()
    want = brute([(i, np.float32(v)) for i, v in rows])
    hit = sum(len({j for j, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit / (10 * len(want)) >= 0.9
    for q, g in got.groupby("query_id"):
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 11)) and g.sort_values("rank").score.is_monotonic_increasing


def test_neighbours_of_clustered_vectors_come_in_bounded_parts(spark, monkeypatch):
    """Nearly all rows in one cell of every table: they are dealt over parts all the same, each row once."""
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    x = (centre + 0.05 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    largest = []
    met = ann._met

    def watched(rows, asked, k, kind, tables, probes, seed, parts):
        largest.append(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts))).count().agg(F.max("count")).first()[0])
        return met(rows, asked, k, kind, tables, probes, seed, parts)

    monkeypatch.setattr(ann, "_met", watched)
    got = ann.search(df, F.col("id") % 100 == 0).toPandas()
    want = brute(list(enumerate(x)))
    assert sum(len({j for j, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id")) / (10 * len(want)) >= 0.9
    assert largest[0] <= 130


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_a_query_is_compared_with_a_third_of_the_rows(sf):
    """Half of brute force's distances at most, at a recall of 0.9."""
    import os

    import pyarrow.parquet as pq

    place = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(place):
        pytest.skip("no test data")
    t = pq.read_table(place).sort_by("vec_id")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), dtype=np.float64)
    index, asked = ann.Index(ids, x, 24, 11), np.flatnonzero(ids % 100 == 0)
    probes = ann.probed(x[asked], 24, 60, 11)
    want = brute(list(zip(ids.tolist(), x, strict=True)))
    compared = np.array([len(index.candidates(p)) for p in probes])
    hits = [len({j for j, _ in want[int(ids[q])]} & set(index.nearest(ids[q], x[q], p, 10)[0].tolist())) for q, p in zip(asked, probes, strict=True)]
    assert compared.mean() <= 0.35 * len(ids) and sum(hits) >= 0.9 * 10 * len(asked)
    assert len(np.unique(index.candidates(probes[0]))) == compared[0] and len(index.candidates(None)) == len(ids)


def test_neighbours_of_many_lengths_keep_the_exact_way(spark):
    rows = [(i, [float(1 + i % 7 + j) * (-1) ** (i * j) for j in range(1 + i % 40)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") % 100 == 0).groupBy("query_id").count().collect()
    same = {d: sum(len(v) == d for _, v in rows) for d in range(1, 41)}
    distinct = {d: len({tuple(v) for _, v in rows if len(v) == d}) for d in same}
    assert {r["query_id"]: r["count"] for r in got} == {i: min(10, same[1 + i % 40] - 1) for i in range(0, 1200, 100)} and min(distinct.values()) > 0


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, []), (7, [1.0, None]), (100, [0.0, 2.0]), (200, [0.5, 0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in ann.search(df, F.col("id") % 100 == 0).collect()}
    assert got == {(0, 1): (1, 0.0), (0, 2): (2, 0.0), (0, 3): (100, 2.236068), (100, 1): (0, 2.236068), (100, 2): (1, 2.236068), (100, 3): (2, 2.236068)}
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------------


def measures(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_measures(spark, docs):
    more = [(100 + i, " ".join(str((i * j) % (3 + i)) for j in range(30 * i))) for i in range(12)]
    df = docs.union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("n_words", F.lit("clash"))
    out = quality.clean_lines(df).collect()
    assert len(out) == len(TEXTS) + 12
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(r["text"]), r["text"]
        assert not (r["base_failed"] and r["kept"])
    assert quality.clean_lines(empty(spark)).count() == 0


def test_quality_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    bad = {
        2: "\n".join(f"menu{i} | item{i} | more{i}" for i in range(40)), 3: "\n".join(f"WORD{i}!! THAT{i}!!" for i in range(40)),
        4: " ".join(f"sym{i}*** t{i}%%%" for i in range(40)) + ".", 5: "\n".join(f"Accept our cookie number {i}." for i in range(40)),
    }
    rows = [(1, good + "\nHome | News | More"), (6, " ".join(f"word{i}" for i in range(60)) + ". And a line cut off"), *bad.items()]
    out = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in out.items() if r["kept"]} == {1, 6}
    assert out[1]["clean_text"] == good
    assert {r["doc_id"] for r in quality.keep_clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 6}


def plain_verdict(t):
    """The line rules once more, line by line: (kept, clean text)."""
    lines = (t or "").split("\n")
    count = Counter(x for x in lines if len(WORD.findall(x)) <= 12 and len(x) <= 120)
    good = []
    for line in lines:
        words = WORD.findall(line)
        low = line.lower()
        end = line.rstrip(common.SPACES + quality.CLOSING)[-1:]
        labels = len(re.findall(r"[.!?|›»·•/:]+(?=[\s\"'”’»)\]]|$)", line))
        bad = (
            not (end in quality.TERMINAL and end or any(x in line for x in (". ", "! ", "? ")))
            or len(re.findall(r"[#*$%&|<>]+", line)) > 0.2 * len(words) or line.count("!!") > 0.3 * len(words)
            or len(line) <= 120 and len(words) <= 12 and labels >= 3 and 2 * len(words) <= 3 * labels
            or len(words) <= 20 and any(re.search(rf"(?<![^\W\d_]){re.escape(x)}(?![^\W\d_])", low) for x in quality.BOILERPLATE)
            or count[line] >= 3
        )
        if not words or not bad:
            good.append(line)
    chars = lambda x: sum(map(len, WORD.findall(x)))
    return not measures(t)[5] and chars("\n".join(good)) >= 0.5 * chars(t or ""), "\n".join(good)


def test_quality_verdicts_equal_a_plain_version(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    odd = [prose + "\nSign in.\nOur blog in design in a dialog in here.\nThe cookie monster " + "eats a lot of things " * 8 + ".", prose + "\nagain.\nagain.\nagain.\n again.", prose + "\nA. B. C.", "यह एक वाक्य है।\n" * 2 + prose, "x\n" * 5 + prose]
    df = table.union(docs).union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in quality.clean_lines(df).select("text", "kept", "clean_text").collect():
        kept, clean = plain_verdict(r["text"])
        assert (r["kept"], r["clean_text"] or "") == (kept, clean), r["text"]


def test_quality_furniture_of_other_languages(spark):
    rows = [
        (1, "\n".join(f"Startseite{i}. Über{i} uns. Impressum{i}." for i in range(40))),
        (2, "\n".join(f"{x} {i}." for i in range(14) for x in ("Mentions légales", "Tous droits réservés", "Acceptez les témoins de connexion"))),
        (3, "\n".join(f"{x} número {i}." for i in range(14) for x in ("Aviso legal", "Política de privacidad", "Iniciar sesión"))),
        (4, "\n".join(f"{x} {i}, bitte." for i in range(14) for x in ("Alle Rechte vorbehalten", "Hier anmelden", "Datenschutz"))),
    ]
    out = quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["kept"], r["kept_chars"]) for r in out] == [(False, 0)] * 4


# 5 -----------------------------------------------------------------------------------------------------------------


def test_html_extraction():
    para = "The cat of the house is in the garden and it was there with all the others for a long time. " * 3
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- x <p>no</p> --><header class="top"><h1>Site</h1></header>
    <div class="ad">Buy the best of it now.</div><div id="cookie-notice">We use them.</div><article><h1>A &amp; B</h1><p><b>{para}<br><p>short &eacute;nd.</p>
    <aside>Also</aside><form><p>Name</p></form><div class="comments"><p>I like the article and the house.</p></div></article><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\n" + para.strip() + "\nshort énd."
    plain = f"<body><div><a href=x>one</a> <a href=y>two</a></div><p>{para}</p><p>short one</p><p>{para}</p><div><a href=z>three</a></div></body>"
    assert html_text.main_text(plain) == f"{para.strip()}\nshort one\n{para.strip()}"
    for odd in (None, "", "<", "<p", "<script>never", "<!-- open", "</div></p>", "&bogus;", "<nav>"):
        assert isinstance(html_text.main_text(odd), str)


EN = "The cat of the house is in the garden and it was there with all the others for a long time. " * 3
IT = "Il gatto della casa dorme nel giardino mentre tutti gli altri guardano la finestra aperta della cucina. " * 4
RU = "Вчера вечером жители города собрались у старого моста, чтобы вместе посмотреть на огни над рекой. " * 4


def test_html_names_are_only_hints():
    """Article elements that hold little, other languages, odd quotes and signs."""
    page = f"<body><div><p>{EN}</p><p>{EN}</p></div><article><a href=x>Read this next</a></article></body>"
    assert html_text.main_text(page) == f"{EN.strip()}\n{EN.strip()}"
    for text in (IT, RU):
        assert html_text.main_text(f"<body><h1>Uno</h1><p>{text}</p><p>{text}</p></body>") == f"Uno\n{text.strip()}\n{text.strip()}"
    assert html_text.main_text(f"<article><p data-x=it's>{EN}</p><p>more's</p></article>") == f"{EN.strip()}\nmore's"
    assert html_text.main_text(f"<article><p>{EN}</p><p>The © sign stands here.</p></article>") == f"{EN.strip()}\nThe © sign stands here."
    cards = "".join(f"<a href={i}><div>{EN}</div></a>" for i in range(3))
    assert html_text.main_text(f"<body><div>{cards}</div><div>{EN}</div></body>") == EN.strip()
    assert html_text.main_text("<p>1 < 2 and a<b and so</p><p title='>'>x</p>").startswith("1 < 2 and a")
    assert html_text.main_text(f"<p>{EN}</p><script/>hidden</script><svg/><p>{EN}</p>") == f"{EN.strip()}\n{EN.strip()}"


def test_html_names_weigh_and_do_not_decide():
    en = EN.strip()
    assert html_text.main_text(f"<body><nav><a href=x>Home</a></nav><div class='social'><p>{EN}</p><p>{EN}</p></div></body>") == f"{en}\n{en}"
    for name in ("related-work", "side", "notice"):
        assert html_text.main_text(f"<article><p>{EN}</p><p class='{name}'>{EN}</p></article>") == f"{en}\n{en}"
    assert html_text.main_text(f"<article><p>{EN}</p><p class='ad'>Buy it now.</p><div class='comments'><p>{EN}</p></div></article>") == en
    assert html_text.main_text(f"<article><p>{EN}</p><figure><img src=x><figcaption>A cat, in 2020.</figcaption></figure><p>{EN}</p></article>") == f"{en}\nA cat, in 2020.\n{en}"
    code = "for i in range(10):\n    print(i * i, compute(i), other_name[i], more_values[i + 1], values)"
    got = html_text.main_text(f"<body><div>{EN}</div><pre>{code}</pre><div>{EN}</div></body>")
    assert got == f"{en}\n{' '.join(code.split())}\n{en}"
    page = f"<body><div>Home</div><div>About us</div><div>{EN}</div><div>A short line.</div><div>{EN}</div><div>Copyright 2020</div></body>"
    assert html_text.main_text(page) == f"{en}\nA short line.\n{en}"
    assert html_text.main_text(f"<article><p>{EN} where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>") == f"{en} where x=2 holds."
    # names of parts still count where the page has other text, and hidden or never shown parts always
    assert html_text.main_text(f"<body><div class='social'><p>{EN}</p></div><div>{EN}</div></body>") == en
    assert html_text.main_text(f"<body><div hidden><p>{EN}</p></div><footer><p>{EN}</p></footer></body>") == ""


def test_html_rules_reject_what_names_need_not():
    import os

    import pyarrow.parquet as pq

    place = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(place):
        pytest.skip("no test data")
    rules = Counter()
    for page in pq.read_table(place)["html"].to_pylist():
        rules.update(why for good, why in html_text.decide(html_text.blocks(page)) if not good)
    assert rules["links"] > rules["outside"] > 0, rules


@pytest.mark.parametrize("piece", ["<a", "<a ", "<a b=\"'", "<a b='x", "<!--", "<script>", "<svg>", "<div>", "</div>", "<div>x</p>", "<p>x", "<span hidden>", "a<", "<a\n=", "<p>x</p>", "&amp", "<li></b>"])
def test_html_hostile_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 8


def plain_blocks(page):
    """A second way to the blocks, by the standard library's parser: (text, linked characters, outside, in an article, heading)."""
    from html.parser import HTMLParser

    found, stack, parts = [], [], []

    class Parser(HTMLParser):
        skip = link = heading = False

        def cut(self):
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = " ".join("".join(t for t, a in parts if a).split())
                found.append((text, len(linked), any(o for _, o in stack), any(t == "article" for t, _ in stack), self.heading))
            parts.clear()

        def handle_starttag(self, tag, attrs):
            if tag in ("b", "meta"):
                return
            if tag in ("a", "br"):
                self.link = tag == "a" or self.link
                parts.append((" " if tag == "br" else "", False))
                return
            self.cut()
            if tag in ("script", "style"):
                self.skip = True
            if stack and (stack[-1][0] in ("p", "h1") or stack[-1][0] == tag == "li"):
                stack.pop()
            self.heading = tag == "h1"
            stack.append((tag, tag in ("nav", "footer", "head") or dict(attrs).get("class") == "ad"))

        def handle_endtag(self, tag):
            if tag == "b":
                return
            if tag == "a":
                self.link = False
                return
            self.cut()
            self.skip = self.heading = False
            while any(t == tag for t, _ in stack) and stack.pop()[0] != tag:
                pass

        def handle_data(self, data):
            if not self.skip:
                parts.append((data, self.link))

    parser = Parser()
    parser.feed(page)
    parser.close()
    parser.cut()
    return found


def test_html_pages_equal_a_plain_version(spark):
    """The blocks of every page of the table by another parser, and each rule seen at work."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    rules = Counter()
    for p in pages:
        made = html_text.blocks(p)
        assert [(b.text, b.linked, b.out, b.inside, b.heading) for b in made] == plain_blocks(p)
        want = [t for t, linked, out, inside, _ in plain_blocks(p) if inside and not out and linked == 0]
        assert html_text.main_text(p) == "\n".join(want)
        for shown in (p, p.replace("<article", "<div").replace("</article", "</div").replace("<nav", "<div").replace("</nav", "</div")):
            rules.update(why for _, why in html_text.decide(html_text.blocks(shown)))
    assert min(rules[x] for x in ("outside", "links", "density", "neighbours", "length", "short page")) > 0, rules
    assert rules["density"] > rules["short page"]


@pytest.mark.parametrize(("attrs", "shown"), [
    ('class="overflow-hidden"', True), ('class="md:hidden flex"', True), ('aria-hidden="false"', True), ('data-title="hidden gems"', True), ('title="display: none"', True), ('data-hidden="1"', True),
    ('hidden="until-found"', True), ("hidden", False), ('class="a" HIDDEN=""', False), ("aria-hidden=true", False), ('style="color: red; display: none"', False), ("style='visibility:hidden'", False),
])
def test_html_hidden_elements(attrs, shown):
    body = "The cat of the house is in the garden and it was there with all the others for a long time."
    assert html_text.main_text(f"<body><div {attrs}><article><p>{body}</p></article></div></body>") == body * shown
    assert html_text.main_text(f"<article><p>a <span {attrs}>b</span></p></article>").split() == ["a", "b"][: 1 + shown]


def test_html_pages_in_other_languages():
    polish = "Wczoraj wieczorem mieszkańcy miasta spotkali się przy starym moście, żeby wspólnie obejrzeć pokaz świateł nad rzeką. " * 3
    dutch = "Gisteren liepen veel bewoners van de stad langs het water omdat iedereen het nieuwe theater graag wilde bekijken. " * 3
    japanese = "昨日の夕方、町の人々は古い橋のそばに集まり、川の上の光を一緒に眺めた。" * 8
    english = "We use cookies and by this you are told that they help us and it is up to you to say no. "
    for text in (polish, dutch, japanese):
        page = f"<body><div><a href=x>{text}</a></div><div>{text}</div><div>{text}</div></body>"
        assert html_text.main_text(page) == f"{text.strip()}\n{text.strip()}"
    assert polish.strip() in html_text.main_text(f"<body><div>{polish * 3}</div><div>{english}</div></body>")
    # a page in a known language still loses blocks without its stop words
    known = "The cat of the house is in the garden and it was there with all the others for a long time. " * 3
    assert html_text.main_text(f"<body><div>{known}</div><div>{'red green blue ' * 20}</div></body>") == known.strip()


def test_html_column(spark):
    df = spark.createDataFrame([(1, None), (2, "<article><p>hello</p></article>")], "page_id long, html string").withColumn("text", F.lit(0)).withColumn("__x", F.lit(1))
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == {1: "", 2: "hello"}
    assert html_text.extract(df.limit(0)).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------------

ODD = ["a" * 3000, "ab'll it's " * 400, " " * 2000 + "x", "<|endoftext|> " * 200, "<|startoftext|>" * 200, "é" * 2500, "é " * 700, "İstanbul ΣΑΣ ς " * 200, "日本語テキスト" * 300, "x" * 50 + " " + "y" * 2500 + " z", "​\x1c\x85 a\x00b " * 100, "🎉👩‍👩‍👧 " * 300]


@pytest.mark.parametrize(("chunk", "overlap"), [(65536, 1024), (700, 16), (1000, 300)])
def test_token_counts_equal_the_library(chunk, overlap):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    counter = token_count.Counter(path, chunk, overlap, remembered=50)
    texts = [t or "" for _, t in TEXTS] + ODD
    assert counter.batch(texts) == [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.batch(texts) == counter.batch(texts)


def test_long_texts_are_spliced(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"length(text) > {token_count.CHUNK}").select("text").collect()]
    whole, counter = Tokenizer.from_file(path), token_count.Counter(path)
    assert len(texts) > 20
    assert counter.batch(texts) == [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.splices >= len(texts) and not counter.memory
    # no white space anywhere: overlaps widen until one chunk holds the text
    odd = ["é" * 30_000, "ab" * 9_000 + " " + "ab" * 9_000]
    assert counter.batch(odd) == [len(whole.encode(t, add_special_tokens=False)) for t in odd]
    assert counter.widened > 0


def test_token_count_column(spark, docs):
    out = token_count.count_tokens(docs.withColumn("n_tokens", F.lit("x")), P.path("word_bpe_49k.json")).collect()
    assert [r["n_tokens"] for r in out if r["text"] in (None, "")] == [0, 0] and len(out) == len(TEXTS)
    assert token_count.count_tokens(empty(spark), P.path("word_bpe_49k.json")).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), sp_fst.Transducer(path, remembered=40)
    for t in [t or "" for _, t in TEXTS] + ODD:
        ids = np.frombuffer(machine.encode(t), "<u4").tolist()
        assert ids == library.encode(t), t[:30]
        assert machine.decode(machine.encode(t)) == t
    out = sp_fst.encode(docs.withColumn("ids", F.lit(1)), path).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out) and len(out) == len(TEXTS)
    assert sp_fst.encode(empty(spark), path).count() == 0


def test_sentencepiece_takes_the_lattice_for_every_word(spark):
    import time

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), sp_fst.Transducer(path)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    rng = np.random.default_rng(2)
    long = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 100_000)), "a" * 100_000, " " * 5000 + "x"]
    for t in [t or "" for t in texts] + ODD + long:
        began = time.perf_counter()
        ids = np.frombuffer(machine.encode(t), "<u4").tolist()
        assert time.perf_counter() - began < 5
        assert ids == library.encode(t)
    assert machine.directly == 0
    # the filter is what makes the path the merges' own: without it the lattice holds other paths
    machine.words.clear()
    machine.runs.clear()
    machine._follows = lambda last, k: True
    machine.beside.clear()
    assert any(np.frombuffer(machine.encode(t or ""), "<u4").tolist() != library.encode(t or "") for t in texts[:50])


def test_sentencepiece_unigram_weights(tmp_path):
    """A unigram model written down by hand from the pieces of the other, with scores of its own."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    rng = np.random.default_rng(8)
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == sp_fst.NORMAL:
            p.score = -float(rng.uniform(2, 14))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), sp_fst.Transducer(path)
    for t in ["the river and the stone", "été naïve 日本", "x" * 300, "a  b", "🎉 ok", *[" ".join("".join(rng.choice(list("etaoinshr"), 7)) for _ in range(40)) for _ in range(20)]]:
        ids = np.frombuffer(machine.encode(t), "<u4").tolist()
        cost = lambda x: sum(-machine.score[i] for i in x)
        assert ids == library.encode(t) or abs(cost(ids) - cost(library.encode(t))) < 1e-3, t
        assert machine.decode(machine.encode(t)) == t
    assert machine.directly == 0


# 8 -----------------------------------------------------------------------------------------------------------------


def labelled(spark):
    rng = np.random.default_rng(3)
    words = {"en": "the of and that with house river stone".split(), "fr": "le les une dans maison rivière pierre être".split(), "de": "der und nicht haus fluss stein über schön".split()}
    rows = [(i, " ".join(rng.choice(words[la], 40)), la) for i, la in enumerate(list(words) * 120)]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", "fr"), (902, "the of", None)], "doc_id long, text string, lang string")


def test_language_id(spark):
    df = labelled(spark)
    model = langid.fit(df.where("doc_id % 5 != 0"), per_language=60)
    out = langid.predict(df.withColumn("score", F.lit("clash")), model).toPandas()
    real = out[(out.doc_id < 900) & (out.doc_id % 5 == 0)]
    assert (real.lang == real.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all() and not real.rejected.any()
    assert out[out.doc_id.isin([900, 901])].lang_pred.tolist() == ["und", "und"] and out[out.doc_id.isin([900, 901])].rejected.all()
    assert langid.predict(df.limit(0), model).count() == 0
    assert langid.fit(df.limit(0)).predict("abc") == ("und", 0.0, True)
    assert langid.fit(df.where("lang = 'en'")).predict("the stone")[0] == "en"
    assert [model.predict(t)[0] for t in (None, "", "½ ² Ⅷ 12 _", "!?")] == ["und"] * 4 and model.predict("ª")[0] != "und"


def test_language_id_leaves_no_label_out(spark):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows = [(i, " ".join([words[i % 60]] * 8), f"l{i % 60}") for i in range(600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=120)
    assert len(model.labels) == 60


def test_language_id_of_long_texts_and_missing_ids(spark):
    from vodmill.llm.queries import held_out

    model = langid.fit(labelled(spark))
    assert model.predict("der fluss und das haus " * 100_000)[0] == "de"
    assert [r[0] for r in spark.createDataFrame([(None,), (3,)], "doc_id long").select(held_out()).collect()] == [True, zlib.crc32(b"3") % 5 == 0]


# 9 -----------------------------------------------------------------------------------------------------------------


def test_packing_places_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, "word " * (i * 37 % 900)) for i in range(200)], "doc_id long, text string")
    df = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(more).withColumn("start", F.lit(1))
    got = packing.pack(df, path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).toPandas()
    library = Tokenizer.from_file(path)
    for d, t in df.select("doc_id", "text").collect():
        g = got[got.doc_id == d].sort_values("start")
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert b"".join(g.ids) == ids.tobytes() and (g.doc_tokens == len(ids)).all()
        assert (g.start.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 1024 and (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all()
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.9
    assert packing.pack(empty(spark), path).count() == 0


def test_cut_is_exact():
    for n in range(1, 5000, 7):
        parts = packing.cut(n, 1024)
        assert sum(parts) == n and min(parts) > 0 and max(parts) <= 1024


# 10 ----------------------------------------------------------------------------------------------------------------


def brute_components(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, n, percent):
    rng = np.random.default_rng(5)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "two one"), (7, "é É"), (8, "É é")]
    at = 10
    for size in (5, 8, 12, 20, 45, 120, 400, 1500, 4000):
        base = [f"w{size}x{i}" for i in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, size // 60, size // 50, size // 40, size // 30, size // 20):
            w = list(base)
            for e in range(edits):
                w[int(rng.integers(size))] = f"e{at}_{e}"
            rows.append((at, " ".join(w) + (" tail" if rng.random() < 0.3 else "")))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, n=n, percent=percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_shuffle_of_texts_and_repeats(spark):
    rows = [(i, "alpha beta gamma delta epsilon zeta eta theta " * (1 + i % 2) + "iota kappa") for i in range(8)] + [(3, "alpha beta gamma delta epsilon zeta eta theta alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, small=0).collect()
    assert len(got) == 9
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: v for k, (_, v) in brute_components(rows).items()}
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def group(rng, at, size, count, share, tag):
    """Texts of ``size`` words of which all but a run of their own are common: pairs of about ``share`` similar shingles."""
    base = [f"{tag}{i}" for i in range(size)]
    own = round(size * (1 - share) / (1 + share))
    rows = []
    for k in range(count):
        start = int(rng.integers(size - own))
        rows.append((at + k, " ".join([*base[:start], *[f"{tag}{k}own{i}" for i in range(own)], *base[start + own:]])))
    return rows


def test_jaccard_groups_are_not_paired_out(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [*group(rng, 0, 150, 300, 0.7, "far"), *group(rng, 1000, 150, 300, 0.93, "near"), *group(rng, 2000, 150, 100, 0.84, "brim")]
    compared = []
    verify = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, *rest: (compared.append(pairs.count()), verify(pairs, *rest))[1])
    refined = jaccard._refined
    monkeypatch.setattr(jaccard, "_refined", lambda *a: (out := refined(*a), compared.append(out.count()))[0])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {k: v for k, (_, v) in brute_components(rows).items()}
    assert sum(compared) < 10 * len(rows), compared  # the pairs of the groups are 94,650


def test_refined_keys_lose_no_link(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = np.unique(rng.integers(0, 400, int(rng.integers(20, 300))))
        for _ in range(3):
            rows.append((len(rows), sorted({*(int(x) for x in base if rng.random() < 0.96), *(int(x) for x in rng.integers(1000, 1200, 4))})))
    sets = spark.createDataFrame([(i, len(x), x) for i, x in rows], "id long, n long, shingles array<long>")
    for percent in (80, 85):
        found = {(r["a"], r["b"]) for r in jaccard._refined(sets.select("id", F.col("id").alias("c")), sets, percent).collect()}
        for i, x in rows:
            for j, y in rows[:i]:
                if 100 * len({*x} & {*y}) >= percent * len({*x} | {*y}):
                    assert (i, j) in found or (j, i) in found


def test_jaccard_ids_with_several_texts_and_none(spark):
    w = [f"w{i}" for i in range(60)]
    v = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (1, " ".join(v)), (2, " ".join([*v, "x"])), (3, " ".join([*w, "y"])), (None, " ".join([*w, "z"])), (None, "alone in here"), (7, "alone in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, 7), (7, 7)], key=str)


def test_parity_sketch_bounds_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    b = np.unique(np.r_[a[:450], rng.integers(0, 2**63, 30).astype(np.uint64)])
    diff = len(np.setxor1d(a, b))
    x, y = jaccard.parity(a, 1024), jaccard.parity(b, 1024)
    assert sum(int(v).bit_count() for v in x ^ y) <= diff
    assert (jaccard.parity(a, 2048)[:16] ^ jaccard.parity(a, 2048)[16:] == x).all()
    ends = jaccard.bands(5000, 85)
    for small in range(1, 2000):
        for large in (small, small * 100 // 85):
            i, j = (int(np.searchsorted(ends, s, side="right")) - 1 for s in (small, large))
            assert j - i in (0, 1)
            assert jaccard.cells_of(i, ends, 85)[0] >= jaccard.most_different(small, large, 85)


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components(links.limit(0), "a", "b").count() == 0


def test_registered_queries_and_checksums(spark):
    from vodmill.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    out = QUERIES["op1_histogram_shards"](spark, "/root/testdata/sf0.001").limit(20).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 1 for r in out)
