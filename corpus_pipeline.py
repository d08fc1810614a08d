"""Corpus pipeline: five stages of ``cardiolake.llm``, each reading what the last one wrote.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.

Defined results: a document without text is rejected by the first stage; called alone,
the later stages keep it (it is near no other, has no window and no secret, and is
packed as its end mark).  Rows without doc_id are judged by their text.  Repeated rows
are one document to the second stage, whose first row of a group is the one with the
smallest doc_id; all rows with that doc_id stay.  Very long texts pass every stage whole.
An empty table gives an empty result.  Columns of other names pass to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardiolake.llm.common import Scratch, width
from cardiolake.llm.decontaminate import decontaminate
from cardiolake.llm.near_dedup import near_dedup
from cardiolake.llm.packing import pack_documents
from cardiolake.llm.quality_classifier import keep_quality
from cardiolake.llm.secrets import redact


def _few_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """After a join: partitions by the bytes of the stage's input, four a core at least,
    however many the shuffle had."""
    return out.coalesce(width(docs.sparkSession, docs, 4))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return _few_files(near_dedup(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return _few_files(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids; small caches, as workers outlive the stages."""
    return pack_documents(docs, cache_words=150_000)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Signatures, trained models and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name, wide=True)
    return STAGES[-1][1](spark, docs, sf_dir)
