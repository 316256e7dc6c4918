"""The corpus pipeline: language ID, quality, near-duplicates, mixing and BPE over the documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result as
Parquet into the shared folder and reads it back as the next stage's docs. All stages but the last return the columns
of ``documents``; the last adds what encoding found. Null columns, empty tables and repeated rows are handled as each
operator's docstring states. SQL can't express the stages, so ORACLE_SQL is None: tests/llm/test_pipeline.py runs all of
them on a small table, and holds language (the posterior), near-duplicates (pairs by count) and encoding (the
tokenizers library) against brute force, mixing against its targets, and quality against held-out labels.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatium.llm import op1_bpe, op2_quality, op5_langid, op8_mixing, op10_simhash
from collatium.llm.common import cut, table

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages; the source stands for the host, the declared language for the markup."""
    model = op5_langid.fit(docs, "doc_id", "text", "lang")
    return op5_langid.identify(docs, model, "text", F.col("lang"), F.col("source"), hold=cut).filter("accepted").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined score reaches the threshold."""
    model = op2_quality.fit(docs, table(spark, sf_dir, "labels"))
    return op2_quality.score(docs, model).filter(F.col("score") >= op2_quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return op10_simhash.keep_one(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights."""
    return op8_mixing.sampled(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids, with the digests of the ids and of what they decode to."""
    return op1_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
