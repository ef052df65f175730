"""Corpus pipeline over ``documents``: language ID, near-duplicates, repeated lines, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given;
all but the last return the columns of ``documents``. ``n_chars`` follows the
text where a stage changes it. SQL cannot express the stages, so the pipeline
is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.llm import language_id, line_dedup, mixing, packing, simhash
from setscope.session import materialize

ORACLE_SQL = None


def _as_documents(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns of documents from ``doc`` and, for the named ones, from the given expressions."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, however uncertain: texts without a letter go; a missing lang is filled in."""
    found = language_id.identify(docs, keep_text=True)
    kept = found.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return _as_documents(kept, docs.columns, text=F.col("text"), lang=F.coalesce(F.col("doc")["lang"], F.col("lang_pred")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document, or an earlier place, has."""
    kept = line_dedup.dedup_lines(docs)
    return _as_documents(kept, docs.columns, text=F.col("text"), n_chars=F.when(
        F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"]))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the rate of its source says."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_stage), ("simhash", simhash_stage), ("line_dedup", line_stage),
          ("mixing", mix_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written under spark.checkpoint.dir and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
