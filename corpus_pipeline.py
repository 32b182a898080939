"""The corpus pipeline over ``documents``: STAGES in order, each one's rows written as Parquet and read again as the next
one's ``docs``.

The stages up to the last return the columns of ``documents``; what they reject is gone for the next one. The last
returns the pieces of the packed sequences. Near duplicates are told by shingles of five words and a Jaccard
similarity of 0.8 or more; the document with the smallest doc_id of each group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstpick.llm import best_fit, language_id, line_dedup, ngram_join, quality_rules
from burstpick.llm.common import discard, read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, words=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)  # the next stage's rows are written, and nothing reads those before any more
        before = [docs]
    return docs
