"""Corpus pipeline: language, quality, repeated lines, near-duplicates, packing.

Every stage works on all that its predecessor kept, and all but the last return
the columns of ``documents``.

* language: documents without a letter, or without one language that holds most
  of their text, go.  The model is learned from the stage's labelled texts.
* quality: documents that fail the base or break a rule go.
* lines: later copies of line runs of 50 words or more are deleted; documents of
  which no line with a word is left go.
* near_duplicates: of each group linked by five-word shingles at a similarity of
  0.8 or more, the document with the smallest id stays; rows repeated with that
  id and the same text stay once.
* packing: pieces of at most 1,024 tokens, each with its sequence and place.

A null in any column but text passes through; an empty table gives an empty
result; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kreditflow.llm import op2_packing, op3_minhash, op6_lines, op7_quality, op10_language
from kreditflow.llm.common import documents, materialize

#: Share of a document that its language must hold.
MIN_SHARE = 0.5
SHINGLE_WORDS = 5


def _columns(rows: DataFrame, like: DataFrame, changed: dict | None = None) -> DataFrame:
    """The columns of ``like`` out of the struct ``row``, some of them replaced."""
    changed = changed or {}
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in like.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = materialize(op10_language.learn(docs), "pipeline-language")
    out = op10_language.predict(docs, F.struct("*"), model)
    sure = (F.col("lang_pred") != op10_language.UNKNOWN) & (F.col("score") >= MIN_SHARE)
    return _columns(out.filter(sure).withColumnRenamed("key", "row"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(op7_quality.judge(docs).filter("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op6_lines.drop_repeated_runs(docs)
    left = (F.col("n_removed") == 0) | (F.col("kept_text") != "")
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(kind)).otherwise(F.col("row.n_chars"))
    return _columns(out.filter(left), docs, changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_minhash.keep_one(docs, shingle_words=SHINGLE_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Mixtures, sketches and tokens are beyond SQL; tests compare the stages with direct computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; every stage is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
