"""Substring de-duplication: line hashing, the earliest occurrence of a line stays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from setscope.llm.text import chunks, release_worker_tables

#: Tasks that one line's occurrences are spread over when they meet the line's first place.
SALTS = 8


def normalised(unit: Column) -> Column:
    """The text that two units must share: lower case, runs of white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(unit, r"[\x20\x09-\x0D]+", " ")))


def _units(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, key, place, d1, d2): every line with a word (``min_words`` of them), with its 128-bit digest."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"),
                        F.posexplode(F.split("text", "\n", -1)).alias("place", "unit"))
    norm = lines.select("id", "key", "place", normalised(F.col("unit")).alias("norm"))
    full = F.col("norm") != ""
    if min_words > 1:
        full = full & (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1 >= min_words)
    return norm.where(full).select(
        "id", "key", "place", F.xxhash64("norm").alias("d1"), F.xxhash64(F.lit(1), "norm").alias("d2"))


def _removed(units: DataFrame) -> DataFrame:
    """(id, key, places) of all lines but the first of their digest; rank: id (null last), text hash, place."""
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key", "place")
    firsts = (units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("d1", "d2", "first",
                                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = units.withColumn("salt", F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int"))
    later = salted.join(firsts, ["d1", "d2", "salt"]).where(rank > F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set("place").alias("places"))


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def dedup_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """Every row of ``docs`` as doc (its other columns), text (kept lines), n_removed, removed.

    Lines that agree after normalisation are one line (all but empty ones;
    with ``min_words`` those of as many words); its earliest occurrence in the corpus stays (smallest doc_id,
    null last, then text hash and place) and all others go, in the same
    document too. ``removed`` holds the [start, end) code-point spans in the
    original text. A null text stays null, an empty one empty. Rows that repeat both doc_id and text are one
    document and get the same result. An empty table gives an empty result.
    Firsts combine map-side and meet the lines under a salt, so a line that
    stands in a third of all documents is spread over tasks.
    """
    gone = _removed(_units(docs, min_words)).withColumnsRenamed({"id": "gone_id", "key": "gone_key"})
    others = [docs[c] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("key"))
    joined = rows.join(gone, rows["doc"]["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["key"] == gone["gone_key"]), "left")
    schema = StructType([rows.schema["doc"], StructField("text", StringType()),
                         StructField("n_removed", IntegerType()), StructField("removed", _SPANS)])
    return joined.select("doc", "text", "places").mapInArrow(_cut, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_worker_tables()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in chunks(batch, "text"):
            kept, n_removed, spans = [], [], []
            for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                drop = set(places or ())
                cut, at = [], 0
                for i, line in enumerate(lines if drop else ()):
                    if i in drop:
                        cut.append({"start": at, "end": at + len(line)})
                    at += len(line) + 1
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                n_removed.append(len(drop))
                spans.append(cut)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(kept, pa.string()), pa.array(n_removed, pa.int32()), pa.array(spans, spans_type)],
                names=["doc", "text", "n_removed", "removed"])
