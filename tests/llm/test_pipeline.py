"""The pipeline's stages against plain versions on a small table."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from vodmill.llm import langid  # noqa: E402

from .test_llm import brute_components, labelled  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    good = {la: " ".join(r["text"] for r in labelled(spark).where(f"lang = '{la}'").limit(60).collect()) for la in ("en", "fr")}
    rows = []
    for i in range(60):
        la = "en" if i % 2 else "fr"
        words = good[la].split()
        body = " ".join(words[i * 9:i * 9 + 80] + [f"u{i}x{k}" for k in range(80)]) + "."
        rows.append((i, body + ("\nhome | news | more" if i % 3 == 0 else ""), la, "s", len(body)))
    rows += [(100, rows[4][1], "fr", "s", 1), (100, rows[4][1], "fr", "s", 1), (101, None, None, None, None), (102, "", "en", "s", 0), (103, "123 456 " * 40 + ".", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    first = stages[names[0]](spark, docs, "")
    got = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(got) == {*range(60), 100} and first.columns == corpus_pipeline.COLUMNS
    assert not any("home |" in t for t in got.values())
    second = stages[names[1]](spark, docs.where("doc_id < 60 OR doc_id = 103"), "")
    assert {r["doc_id"] for r in second.collect()} == set(range(60))
    third = stages[names[2]](spark, first, "")
    left = sorted(r["doc_id"] for r in third.collect())
    want = brute_components([(r["doc_id"], r["text"]) for r in first.collect()], 5, 80)
    assert left == sorted({c for _, c in want.values()})
    fourth = stages[names[3]](spark, third, "").toPandas()
    assert sorted(fourth.doc_id.unique()) == left
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs.limit(0), "").count() == 0
    assert langid.fit(docs.limit(0)).labels == []


def test_near_duplicates_keep_every_text_of_an_id(spark):
    w, v, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "wvu")
    rows = [(1, w), (1, v), (1, v), (2, v + " x"), (3, w + " y"), (None, u), (None, u + " z"), (4, u), (5, ""), (5, ""), (6, "other words here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, w), (1, v), (4, u), (5, ""), (5, ""), (6, "other words here")], key=str)
    assert out.columns == corpus_pipeline.COLUMNS


def test_run_reads_documents(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 60 + ".", "en", "s", 1)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
