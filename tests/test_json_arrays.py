"""JSON documents read element by element, whatever the pieces cut through; files dealt by size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vodmill.sources import dealing, files
from vodmill.sources import json_arrays as J


def pieces(text, size):
    return lambda: (text[i:i + size] for i in range(0, len(text), size))


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(['a', '"', "\\", "[", "}", ",", ":", "é", "\n", "日"]) for _ in range(rng.randrange(6)))
    if kind < 4:
        return rng.choice([None, True, -1.5e3, 7])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_elements_equal_the_json_module(size):
    rng = random.Random(size)
    for k in range(60):
        rows, heads = [value(rng) for _ in range(rng.randrange(6))], value(rng)
        doc = {"x": value(rng), "rows": rows, "heads": heads, "y": {"rows": [1]}} if k % 2 else {"heads": heads, "x": value(rng), "rows": rows}
        text = json.dumps(doc, ensure_ascii=bool(k % 3), indent=rng.choice([None, 1, "\t"]))
        got = list(J.parsed(pieces(text, size), "rows", "heads"))
        assert [g[0] for g in got] == list(range(len(rows))) and not any(g[3] for g in got)
        assert [json.loads(g[1]) for g in got] == rows and all(json.loads(g[2]) == heads for g in got)


@pytest.mark.parametrize("size", [1, 5, 1000])
@pytest.mark.parametrize(("text", "rows", "said"), [
    ("", 0, "early"), ("[1]", 0, "no JSON object"), ('{"rows": 3}', 0, "no array"), ('{"rows": {"a": 1}}', 0, "no array"), ('{"rows": [1, 2', 1, "early"), ('{"rows": [1,,2]}', 1, "missing"),
    ('{"rows": [1]} x', 1, "follows"), ('{"rows" [1]}', 0, "expected"), ('{"rows": ["a\\', 0, "early"), ('{"rows": [{"a": 1}', 1, "early"), ('{"rows": null}', 0, "no array"), ("{}", 0, None), ('{"rows": []}', 0, None), ('{"other": 1}', 0, None),
])
def test_broken_documents(size, text, rows, said):
    got = list(J.parsed(pieces(text, size), "rows", None))
    assert sum(g[1] is not None for g in got) == rows
    assert [g[3] for g in got if g[3]] == [] if said is None else said in got[-1][3]


def test_memory_holds_a_piece_and_an_element():
    n, most = 20_000, 0

    def big():
        yield '{"rows": ['
        for i in range(n):
            yield ("," if i else "") + json.dumps(["x" * 50, i])
        yield '], "z": "' + "y" * 10 + '"}'

    text = J.Text(big())
    names = J.members(text)
    assert next(names) == "rows"
    for k, e in enumerate(J.elements(text)):
        most = max(most, len(text.held))
        assert k % 5000 or json.loads(e)[1] == k
    assert k == n - 1 and most < 1000


def test_report_of_one_large_file(spark, tmp_path):
    rows = [[str(i), "v" * 200, None, "extra"] for i in range(30_000)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "late.json").write_text(json.dumps({"rows": rows, "columnHeaders": [{"name": "id"}, {"name": "x"}, {"name": "x"}]}))
    (tmp_path / "r" / "none.json").write_text("{}")
    out = files.read_report_json(spark, str(tmp_path / "r"))
    assert out.count() == 30_000
    r = out.where("position = 12345").first()
    assert r["record"] == {"id": "12345", "x": None}
    (tmp_path / "r" / "bad.json").write_text('{"rows": [[1]')
    with pytest.raises(Exception, match=r"bad.json: the text ends early"):
        files.read_report_json(spark, str(tmp_path / "r")).collect()


def test_caption_lines(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"events": [{"tStartMs": 3661000, "segs": [{"utf8": "a  b"}, {"utf8": " "}, {"utf8": "c"}]}, {"segs": [{"utf8": "\\n"}]}, {"tStartMs": 5999, "segs": [{"utf8": "d"}]}]}')
    assert sorted(map(tuple, files.read_caption_lines(spark, str(f)).collect())) == [("c.json", 0, "01:01:01 a  b c"), ("c.json", 2, "00:05 d")]


def test_files_are_dealt_by_bytes(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 2000) for _ in range(3000)] + [500_000, 90_000]
    df = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(sizes)], "path string, length long")
    old, dealing.OPEN_BYTES = dealing.OPEN_BYTES, 1
    try:
        out = dealing.dealt_by_size(df, task_bytes=50_000)
        tasks = out.withColumn("t", F.spark_partition_id()).groupBy("t").agg(F.sum("length").alias("b"), F.count("*").alias("n")).collect()
    finally:
        dealing.OPEN_BYTES = old
    assert sum(t["n"] for t in tasks) == len(sizes) and sorted(t["b"] for t in tasks if t["n"] == 1)[-2:] == [90_000, 500_000]
    assert max(t["b"] for t in tasks if t["n"] > 1) < 54_000 and len(tasks) < 90
    assert dealing.dealt_by_size(df.limit(0)).count() == 0
