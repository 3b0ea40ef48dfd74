"""Metrics CSV: records that cross input splits, hostile quotes, headers."""

import csv
import io
import random

import pytest

from vodmill.sources import quoted_csv as Q


def plain(text):
    """The rows as Python's csv module reads them, blank lines left out."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline=""))]
    head = [Q.normalize_header(c) for c in rows[0]]
    fill = lambda r: dict(zip(head, r + [None] * (len(head) - len(r)), strict=False))
    return [fill(r) for r in rows[1:] if len(r) > 1 or r and r[0].strip()]


def read(spark, path):
    df = Q.read_metrics_csv(spark, str(path))
    return df, sorted((tuple(r[c] or "" for c in sorted(df.columns)) for r in df.collect()))


def same(spark, path, text):
    path.write_text(text, encoding="utf-8", newline="")
    df, got = read(spark, path)
    want = plain(text)
    assert got == sorted(tuple((r[c] or "").replace("\r\n", "\n") for c in sorted(r)) for r in want)
    return df


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_quoted_line_breaks_at_every_split(spark, tmp_path, small_splits):
    """Splits of 64 bytes: records begin, go on and end in them at every place."""
    rng = random.Random(1)
    for k in range(6):
        rows = []
        for i in range(40):
            note = "".join(rng.choice(['a', ',', '\n', '""', ' ', 'bc']) for _ in range(rng.choice([0, 3, 12, 200 if i % 9 == 0 else 8])))
            rows.append(f'{i},"{note}",{"x" * rng.randrange(9)},"{rng.randrange(9)}"' if rng.random() < 0.7 else f"{i},{'y' * rng.randrange(40)},,5")
        df = same(spark, tmp_path / f"f{k}.csv", "Video ID,Note,Title (%),Views\n" + "\n".join(rows) + ("\n" if k % 2 else ""))
        assert df.columns == ["video_id", "note", "title_pct", "views"]


def test_plain_files_are_split_too(spark, tmp_path, small_splits):
    text = 'Date,"Views"\n' + "".join(f'"Aug {i % 28 + 1}, 2026",{i}\n' for i in range(400))
    df = same(spark, tmp_path / "p.csv", text)
    assert df.rdd.getNumPartitions() > 50
    stitched = tmp_path / "q.csv"
    df = same(spark, stitched, text + '"a\nb",7\n')
    assert df.rdd.getNumPartitions() > 50


@pytest.mark.parametrize("text", [
    'A,B\n1,5" pipe\n2,"x"\n', 'A,B\n1,"open to the end\nof, the file', 'A,B\r\n1,"x\r\ny"\r\n\r\n2,z\r\n', 'A,B\n1\n2,3,4\n"5","6","7"\n', '﻿A,"B\nb"\n1,"2\n3"\n', 'A,B\n,\n"",""\n',
])
def test_odd_files(spark, tmp_path, text):
    same(spark, tmp_path / "odd.csv", text)


def test_states_of_lines():
    for line, out, in_ in [("a,b", False, True), ('a,"b', True, False), ('"a","b"', False, True), ('5" x', False, False), ('x"', False, False), ('""', False, True), ('a""', False, True), ('"a"b"c', False, True), ("", False, True), (',"', True, False)]:
        assert Q.ends_inside(line, False) == out, line
    assert Q.ends_inside('b"', True) is False and Q.ends_inside('b""', True) is True and Q.ends_inside('b","c', True) is True and Q.ends_inside("b", True) is True


def test_begun_inside():
    effects = {("f", 0): (True, False, True), ("f", 30): (True, False, True), ("g", 0): (True, True, False)}
    splits = [("g", 0), ("f", 0), ("f", 10), ("f", 20), ("f", 30), ("f", 40), ("g", 9)]
    assert Q.begun_inside(splits, effects) == {("f", 10): 0, ("f", 20): 0, ("f", 30): 0, ("g", 9): 0}


def test_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a b.csv", "Views, views ,Date\n1,2,x\n"), ("c.csv", "Date,Likes\ny,3\n"), ("d.csv", 'Date,Likes\n"z\nz",4\n')):
        (tmp_path / "in" / name).write_text(text)
    df = Q.read_metrics_csv(spark, str(tmp_path / "in" / "*.csv"))
    assert sorted(map(tuple, df.select("views", "date", "likes").fillna("-").collect())) == [("-", "y", "3"), ("-", "z\nz", "4"), ("2", "x", "-")]
    for text in ("", "\n1,2\n"):
        (tmp_path / "e.csv").write_text(text)
        with pytest.raises(ValueError, match="no header"):
            Q.read_metrics_csv(spark, str(tmp_path / "e.csv"))


def test_quoted_fields_in_any_column_need_no_stitching(spark, tmp_path, small_splits):
    import re

    for line, whole in [('a,"b",c', True), ('"a","","c, d"', True), ('a,"b ""x"" c"', True), (',"",', True), ('a,"b', False), ('a,"b"c,d', False), ('a,b"c', False), ('a,"b",c"', False)]:
        assert bool(re.search(Q.WHOLE, line)) == whole, line
    df = same(spark, tmp_path / "later.csv", 'Video ID,Title,Position\n' + "".join(f'{i},"a, {i}",""\n' for i in range(300)))
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    df = same(spark, tmp_path / "open.csv", 'Video ID,Title,Position\n' + "".join(f'{i},"a, {i}",""\n' for i in range(300)) + '7,"a\nb",""\n')
    assert "MapInArrow" in df._jdf.queryExecution().toString()


def test_finding_the_splits_sorts_no_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,Views\n" + "x,1\n" * 50)
    seen = []
    lines = Q._lines(spark, str(tmp_path / "s.csv"))
    grouped = type(lines.groupBy("file"))
    agg, grouped.agg = grouped.agg, lambda self, *c: seen.append(agg(self, *c)) or seen[-1]
    try:
        splits = Q._splits(lines)
    finally:
        grouped.agg = agg
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert list(Q._heads(lines, splits).values()) == ["Date,Views"]
