"""Every registered query of the training-data operators over a whole table, held against SQL or against plain rules."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from vodmill.llm import langid, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def made(spark):
    held = {}

    def run(name):
        if name not in held:
            held[name] = entry.queries()[name](spark, SF).collect()
        return held[name]

    return run


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_query_runs_over_the_whole_table(made, docs, name):
    rows = made(name)
    assert rows
    if name.split("_")[0] in ("op1", "op4", "op6", "op7", "op8", "op10", "op12", "op13"):
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_its_sql(made, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    show = lambda rows: sorted(repr(r) for r in rows)
    assert show(tuple(r) for r in cur.fetchall()) == show(tuple(r[c] for c in names) for r in made(name))


def test_shards_are_gapless_and_even(made, docs):
    by, size = defaultdict(list), defaultdict(int)
    for r in made("op1_histogram_shards"):
        assert r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode())
        by[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(len((t or "").encode()) + 1 for t in docs.values())


def test_pieces_hold_each_id_once(made):
    pieces, room = defaultdict(list), defaultdict(list)
    for r in made("op9_harmonic_packing"):
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for (_, total), p in pieces.items():
        at = 0
        for start, length in sorted(p):
            assert start == at and length > 0
            at += length
        assert at == total
    for p in room.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def test_languages_equal_a_plain_version(made, docs, spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where(~queries.held_out()))
    for r in made("op8_language_id"):
        text = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z, n = np.zeros(len(model.labels)), 0
        for b in langid.buckets(text, len(model.table)):
            z, n = z + model.table[int(b)], n + 1
        z = (z / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.labels[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-9


def test_token_counts_and_pieces_equal_the_libraries(made, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    whole.no_truncation()
    whole.no_padding()
    for r in made("op6_token_counts"):
        text = docs[r["doc_id"]] or ""
        n = len(whole.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048)
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    for r in made("op7_sentencepiece_fst"):
        ids = np.array(pieces.encode(docs[r["doc_id"]] or ""), "<u4")
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
