"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed per source; a source's repetition rate is its target over
its size; every document is emitted floor(rate) times, plus once more with a
probability equal to the fraction of the rate. The draws of a source are not
independent: with its documents by size, largest first, and one start seeded by
the source, a document draws a copy where start + place * fraction passes a
whole number, so any run of them holds its share of copies. The few documents
that are large beside their source draw first, and the words they took too
many or too few go to the fraction of the others, whose mean stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
#: A document draws first if it holds more than one part in so many of its source (so fewer than that many do).
HEAD = 64
#: Parts by coin into which documents of one source and size are dealt.
SLOTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone (a null id counts as an empty one)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row per source.

    Sources by code point, null last, get the weights in turn. All sizes
    together are shared out by weight; a target stops at ``most`` times the
    source's size and the excess goes to the others by weight. Sorted by
    limit over weight, the sources that stop come first, so the common level
    (target per weight) is the first one that its own source can take (of
    sources with one limit the first, which has the highest level). The
    windows without a key run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select(
        "source", "source_size", (F.col("source_size") * F.lit(most)).alias("most"),
        F.element_at(F.array(*map(F.lit, weights)),
                     ((F.row_number().over(by_name) - 1) % F.lit(len(weights)) + 1).cast("int")).cast("long").alias("w"))
    order = [(F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double")
             / F.sum("w").over(after))
    levelled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), -F.col("level"), "level"))
    common = F.min(fits).over(every)["level"]
    return levelled.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("most").cast("double"), common * F.col("w")),
                   F.col("most").cast("double")).alias("target"))


def key_of_source(source: Column) -> Column:
    """A key for joins that is never null, different for null and every text."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _draws(start: Column, fraction: Column, before: Column, last: Column) -> Column:
    """Copies drawn at the places from before + 1 to last."""
    return F.floor(start + fraction * last) - F.floor(start + fraction * before)


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
                size: Column | None = None) -> DataFrame:
    """One row per document: ``doc`` (all its columns), size, source_size, target, copies.

    ``docs`` needs doc_id, source and text, or in its place the ``size`` of a
    document; further columns ride inside ``doc``, so their names can clash
    with nothing. A null or empty text has size 0; a null source is a source
    of its own; documents of one size draw in the order of a coin seeded by
    their id, so rows that repeat an id draw one after the other. An empty
    table gives an empty plan.

    A document's place is the number of larger ones of its source, from
    counts per (source, size), that of the coins before its slot, from counts
    per (source, size, slot), and its row number among the rest. So no window
    runs over a source: the largest one runs over the distinct sizes of one,
    or over the documents of one source, size and slot.
    """
    size = word_count(docs["text"]) if size is None else size
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), size.cast("long").alias("size")).select(
        "doc", "size", key_of_source(F.col("doc")["source"]).alias("key"), coin(F.col("doc")["doc_id"], seed).alias("coin")
    ).withColumn("slot", F.floor(F.col("coin") * SLOTS).cast("int"))
    narrow = docs.select(docs["source"], size.cast("long").alias("size"), coin(docs["doc_id"], seed).alias("coin"))
    cells = narrow.groupBy("source", "size", F.floor(F.col("coin") * SLOTS).cast("int").alias("slot")).agg(
        F.count("*").alias("n"))
    of_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = source_targets(of_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                             weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))) \
        .otherwise(F.lit(0.0))
    rated = sources.withColumn("rate", rate).select(
        key_of_source(F.col("source")).alias("key"), "source_size", "target", F.floor("rate").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("fraction"), coin(F.concat(F.lit("first:"), key_of_source(F.col("source"))), seed).alias("start"),
        coin(F.concat(F.lit("others:"), key_of_source(F.col("source"))), seed).alias("start_of_others"))

    larger = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = of_size.select(key_of_source(F.col("source")).alias("key"), "size", "n").withColumn(
        "larger", F.coalesce(F.sum("n").over(larger), F.lit(0).cast("long"))).join(rated, "key")
    first = F.col("size") * HEAD > F.col("source_size")
    drawn = _draws(F.col("start"), F.col("fraction"), F.col("larger"), F.col("larger") + F.col("n"))
    words = F.col("n") * F.col("size")
    none = F.lit(0).cast("long")
    owed = placed.groupBy("key").agg(
        F.coalesce(F.sum(F.when(first, F.col("n"))), none).alias("n_first"),
        F.coalesce(F.sum(F.when(first, words)), none).alias("words_first"),
        F.coalesce(F.sum(F.when(first, drawn * F.col("size"))), none).alias("drawn_first"),
        F.coalesce(F.sum(F.when(~first, words)), none).alias("words_others"), F.max("size").alias("largest"))
    owes = F.col("fraction") * F.col("words_first") - F.col("drawn_first")
    # what is owed is less than the largest document, so the others' fraction stays within 0 and 1, and its mean the same
    room = F.least(F.col("fraction"), F.lit(1.0) - F.col("fraction")) / F.col("largest")
    fraction = F.when(F.col("words_others") > 0, F.col("fraction") + owes * F.least(F.lit(1.0) / F.col("words_others"), room)
                      ).otherwise(F.col("fraction"))
    groups = placed.join(owed, "key").select(
        "key", "size", "source_size", "target", "whole",
        F.when(first, F.col("larger")).otherwise(F.col("larger") - F.col("n_first")).alias("larger"),
        F.when(first, F.col("start")).otherwise(F.col("start_of_others")).alias("start"),
        F.when(first, F.col("fraction")).otherwise(fraction).alias("fraction"))

    lower = Window.partitionBy("key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(key_of_source(F.col("source")).alias("key"), "size", "slot", "n").withColumn(
        "lower", F.coalesce(F.sum("n").over(lower), none)).drop("n").join(groups, ["key", "size"])
    within = Window.partitionBy("key", "size", "slot").orderBy("coin", F.col("doc")["doc_id"])
    place = F.col("larger") + F.col("lower") + F.col("nth")
    copies = F.col("whole") + _draws(F.col("start"), F.col("fraction"), place - 1, place)
    return sized.withColumn("nth", F.row_number().over(within)).join(starts, ["key", "size", "slot"]).select(
        "doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` repeated by its plan, columns unchanged."""
    plan = mixing_plan(docs, **options).where(F.col("copies") > 0)
    repeated = plan.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("doc.*")
