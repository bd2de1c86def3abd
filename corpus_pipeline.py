"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as
Parquet before the next one reads it. Stages but the last return the columns of `documents`. What a
stage has written for itself is read by its result, and is deleted when the next stage begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common, queries
from quantloom.llm.jaccard_join import JaccardSettings, keep_one_of_each
from quantloom.llm.packing import pack
from quantloom.llm.quality_rules import keep_quality
from quantloom.llm.secret_scan import redact
from quantloom.llm.suffix_dedup import SuffixSettings, drop_repeated_strings

#: Repeats of over 50 words are cut, however short the words; op2's length in bytes is its own.
PASSAGES = SuffixSettings(words=51)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables of the stages so far, which nothing reads once the last stage's result is written.
_LEFT: list[DataFrame] = []


def _clears(stage: Stage) -> Stage:
    """Deletes what earlier stages left, but for tables that this one's input reads (if it was not
    written after all)."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = common.discard_unread(_LEFT, docs)
        before = {id(x) for x in common.written()}
        out = stage(spark, docs, sf_dir)
        _LEFT.extend(x for x in common.written() if id(x) not in before)
        return out

    return run


@_clears
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return keep_quality(docs)


@_clears
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, one row stays, that of
    the smallest id; repeated rows and rows without an id are members like others."""
    return keep_one_of_each(docs, JaccardSettings(words=5, percent=80))


@_clears
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur at two places are cut out at both; every document stays."""
    return _measured(drop_repeated_strings(docs, PASSAGES))


@_clears
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _measured(redact(docs))


@_clears
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence of at most 1024 tokens and their offset in it. Executors are
    full from the stages before, so the encoders are lean."""
    return pack(docs, queries.tokenizer(queries.BYTE_BPE), end_id=2, capacity=1024, lean=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage")
        _LEFT[:] = [*common.discard_unread(_LEFT, docs), docs]
    _LEFT.remove(docs)  # the caller's
    return docs
