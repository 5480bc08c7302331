"""A training-data pipeline over `documents`: each stage works on all that the one before kept.

Language ID, n-gram Jaccard join, suffix-array dedup, benchmark decontamination, BPE
encoding. A stage's result is written as Parquet in the shared folder and read back, so a
lost executor never costs more than the stage that runs. All but the last stage return the
columns of `documents`.

Defined cases: rows with a null id link with nothing and stay; a text that loses all its bytes
stays as an empty text; an empty table runs through as one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import op5_language, op6_suffix, op7_jaccard, op8_bpe, op10_decontaminate
from llm.tables import documents, drop, made, small_batches, table
from playbill.session import materialize


_left: list[DataFrame] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stage before it stored on its way: that stage's
    result has been written when the next one is called."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(_left)
        _left.clear()
        before = len(made)
        small_batches(spark)
        out = work(spark, docs, sf_dir)
        _left.extend(made[before:])
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter."""
    found = op5_language.identify(docs, op5_language.fit(docs), keep=tuple(docs.columns), names=("_lang_pred", "_lang_score"))
    return found.where(F.col("_lang_pred") != op5_language.UNKNOWN).select(*docs.columns)


@stage
def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    groups = op7_jaccard.similar_documents(docs)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


@stage
def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that came earlier are cut out of the texts."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = op6_suffix.without_repeats(docs, keep=rest, as_text=True)
    out = out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))
    return out.select(*docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    indexes = op10_decontaminate.build(table(spark, sf_dir, "benchmark"))
    return op10_decontaminate.mark(docs, indexes, name="_hits").where(F.size("_hits") == 0).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: (doc_id, lang, source, n_tokens, ids)."""
    return op8_bpe.encode_texts(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("jaccard", jaccard), ("suffixes", suffixes), ("decontaminate", decontaminate), ("encode", encode)]

# SQL cannot express the trained, hashed and tokenizing stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, work in STAGES:
        docs = materialize(work(spark, docs, sf_dir), name)
    return docs
