"""Which documents models learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for the ids that models may learn from; a null id is in no fold."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn_only: bool,
                   seed: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``per_class`` documents of each label 0 and 1, and all labels' counts.

    Ids come in the order of a seeded hash. Labels that repeat an id count
    once, by their largest value; null ids, labels and texts are left out;
    of repeated documents the smallest text counts. The ids are few, so they
    are broadcast to the documents.
    """
    own = labels.where(labels["doc_id"].isNotNull() & labels[label].isin(0, 1))
    if learn_only:
        own = own.where(learnable(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    picked = [own.where(F.col("label") == v).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class)
              for v in (0, 1)]
    rows = (docs.select("doc_id", "text").where("text is not null")
            .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    return rows, counts
