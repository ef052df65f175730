"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.llm import (collocations, hard_negatives, html_extract, language_id, licenses, line_dedup, minhash, mixing, oracles, packing,
                          quality, simhash, topk, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix plan of all documents: target of each source and words taken of each document."""
    docs = _table(spark, sf_dir, "documents")
    plan = mixing.mixing_plan(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), size=F.col("size"))
    return plan.select(F.col("doc")["doc_id"].alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept text of every document, and the code-point spans of the lines that went."""
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return kept.select(F.col("doc")["doc_id"].alias("doc_id"), "text", "n_removed", spans.alias("removed_spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    found = language_id.identify(_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc")["doc_id"].alias("doc_id"), "held_out", "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and detected licenses of every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda p: p["start"].cast("long"))
    base = F.array_distinct(F.transform("base", lambda p: p["label"]))
    method = F.transform("found", lambda p: p["label"])
    return found.select(
        F.col("doc")["doc_id"].alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, method)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda p: p["confidence"])), F.lit(0.0)).alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every vec_id divisible by 50 against all embeddings."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vec_id divisible by 100 for each of its five positives."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, turned)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of two to four words of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_toxicity": op9_toxicity,
    "op10_top_k": op10_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minhash": op12_minhash,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op2_mixing": oracles.MIXING,
    "op10_top_k": oracles.TOP_K,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_minhash": oracles.MINHASH,
    "op13_collocations": oracles.COLLOCATIONS,
}
