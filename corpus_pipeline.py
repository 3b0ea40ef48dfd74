"""Documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
between stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vodmill.llm import jaccard, langid, quality
from vodmill.llm.common import materialize, table
from vodmill.llm.queries import held_out, packed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: five-word shingles, Jaccard similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
#: Up to so many ids are broadcast; beyond it they are joined by shuffle.
SMALL = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines leave the text; documents that lose too much or fail the base rules go.

    A NULL or empty text has no words and goes; repeated rows are judged each; an empty table gives an empty result.
    """
    kept = quality.keep_clean(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of rejected language go; a missing ``lang`` is filled with the prediction.

    NULL texts and texts without a letter have no language and go; repeated rows are judged each;
    without labelled rows nothing can be told and all go; an empty table gives an empty result.
    """
    model = langid.fit(docs.where(~held_out()))
    kept = langid.predict(docs.select(*COLUMNS), model).where(~F.col("rejected"))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def _ids(found: DataFrame) -> DataFrame:
    found = materialize(found.select("doc_id").distinct(), "ids")
    return F.broadcast(found) if found.count() <= SMALL else found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once.

    Rows that repeat an id with another text, and rows without an id, are documents of
    their own: each stays unless its text links with one that stays. Texts without a word
    link with nothing and all stay; an empty table gives an empty result.
    """
    groups = materialize(jaccard.jaccard_components(docs.select("doc_id", "text"), n=WORDS, percent=PERCENT, marks=True), "groups")
    docs = docs.select(*COLUMNS)
    if not groups.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return docs.join(_ids(groups.where("component_id < doc_id")), "doc_id", "left_anti").select(*COLUMNS)
    stay = groups.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "n_shingles")).alias("k"))
    stay = stay.select(F.col("k.doc_id").alias("__id"), F.col("k.fp").alias("__fp"), F.col("k.n_shingles").alias("__n"))
    marked = docs.withColumn("__set", jaccard.set_marks("text", WORDS))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__set.fp") == F.col("__fp")) & (F.col("__set.n") == F.col("__n"))
    kept = marked.where("__set.n > 0").join(stay, same, "left_semi").dropDuplicates(["doc_id", "__set"])
    return kept.unionByName(marked.where("__set.n = 0")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 token ids, a row per piece.

    A NULL text is packed as an empty one, a single id; repeated rows are packed each; an empty table gives an empty result.
    """
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules), ("language id", language_id), ("near duplicates", near_duplicates), ("packing", packing),
]
#: No SQL expresses the model, the similarity groups or the tokens; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
