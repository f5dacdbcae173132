"""The training-data pipeline over `documents`: each stage works on what the one before it has kept.

quality       rejects low-quality documents (pairwise ranking, operator 5)
exact_dedup   of equal texts one document stays (block naming, operator 8)
near_dedup    of each group of near copies one document stays (n-gram Jaccard join, operator 9: five words, 80 percent)
decontaminate documents that hold a benchmark item go (all within 15 percent of its length, operator 4)
tokenize      ids and decoded text of what is left (BPE, operator 1)

Stages decide by row, which is its doc_id, null or not, and its text: a doc_id that repeats with other texts, or is null, takes no
other row along. Of near copies the row with the least doc_id stays, null before all others.

A stage's result is written before the next one begins, so each stage first removes the last one's scratch tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from lotweave.llm.common import documents, durable, scratch

WORDS, PERCENT = 5, 80

_scratch: list = []


def _stage(f):
    """A stage whose scratch tables go when the next one begins."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(_scratch):
            return f(spark, docs, sf_dir)

    return run_stage


def _rows(docs: DataFrame) -> DataFrame:
    """docs with what names a row: a struct, so that null ids are equal and smaller ids come first."""
    return docs.withColumn("_row", F.struct("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose _row is in gone."""
    return _rows(docs).join(gone.select("_row").distinct(), "_row", "left_anti").select(*docs.columns)


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranker = quality.train(docs, documents(spark, sf_dir, "labels"))
    scored = durable(quality.score(_rows(docs), ranker, key="_row"))
    return _without(docs, scored.where(F.col("score") < quality.ACCEPT))


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = durable(jaccard_join.components(_rows(docs), key="_row", words=WORDS, percent=PERCENT, count=False))
    return _without(docs, found.where(F.col("_row") != F.col("component_id")))


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, durable(decontaminate.contaminated(_rows(docs), documents(spark, sf_dir, "benchmark"), key="_row")))


@_stage
def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs, bpe.vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("tokenize", tokenize_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs


#: The ranking, the embedding and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
