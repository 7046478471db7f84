"""From raw documents to token files: quality, near duplicates, decontamination, mixing, tokens.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from offermill.llm import decontaminate, factorization, jaccard_join, mixing, token_files
from offermill.llm.registry import table
from offermill.session import ensure_checkpoint_dir, ship_package

ROWS_PER_BATCH = "2000"  # whole documents in an Arrow batch, so that a batch stays at a few megabytes on both sides

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"


def _prepared(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
        ship_package(spark)
        ensure_checkpoint_dir(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_prepared
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents given.

    Null and empty texts are scored like any other; repeated rows are judged alike; an empty table gives no rows.
    """
    return factorization.accepted(docs, table(spark, sf_dir, "labels"))


@_prepared
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest id.

    Null and empty texts are near nothing and stay; of rows that repeat an id one stays, rows without an id all stay.
    """
    return jaccard_join.one_per_group(docs)


@_prepared
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark takes nothing out."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


@_prepared
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as it is taken.

    Null sources are one source, a source without words is not taken from; repeated rows are documents of their own.
    """
    return mixing.mixed(docs)


@_prepared
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32, shard, block."""
    return token_files.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("tokens", tokens),
]

# A trained classifier has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = token_files.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
