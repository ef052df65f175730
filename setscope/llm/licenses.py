"""License scan by ordered signature rules (DataFrame functions only)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.llm.license_rules import NOTICE, rules

#: Places of a text that are worked on in one array.
BLOCK = 128
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULE = ("array<struct<number:int,label:string,priority:int,confidence:double,keywords:array<string>,"
         "base:boolean,regex:string>>")


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased.

    ``lower`` also changes letters outside ASCII, which no rule looks at; the
    two that would become ASCII letters are set aside first.
    """
    low = F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))
    return F.filter(F.split(F.coalesce(low, F.lit("")), SEPARATORS, -1), lambda w: w != "")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scanned(items: Column, carry: Column, step, out: str) -> Column:
    """What ``step`` gives for every item in turn, from the carry that the items before left.

    An array grows by copying, so items go in blocks: a text costs a step per
    item and some copying within its block, not of all items before.
    """
    none = F.array().cast(f"array<{out}>")

    def state(carry: Column, block: Column, done: Column) -> Column:
        return F.struct(carry.alias("carry"), block.alias("block"), done.alias("done"))

    def one(s: Column, item: Column) -> Column:
        left, given = step(s["carry"], item)
        return state(left, F.concat(s["block"], F.array(given)), s["done"])

    def of_block(s: Column, block: Column) -> Column:
        return F.aggregate(block, s, one, lambda x: state(x["carry"], none, F.concat(x["done"], F.array(x["block"]))))

    def run(bound: Column) -> Column:
        last = F.greatest(F.floor((F.size(bound) - 1) / BLOCK).cast("int"), F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(bound, i * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, state(carry, none, F.array().cast(f"array<array<{out}>>")), of_block,
                           lambda s: F.flatten(s["done"]))

    return _let(items, run)


def _places(line: Column, rule: Column) -> Column:
    """Every match of a rule in a line of words, as word intervals [start, end)."""
    between = F.split(line, rule["regex"], -1)

    def step(before: Column, x: Column) -> tuple[Column, Column]:
        return before + x["gap"] + x["words"], F.struct(
            (before + x["gap"] - 1).alias("start"), (before + x["gap"] + x["words"]).alias("end"))

    def spans(found: Column) -> Column:
        # one gap more than matches: the last one has no match
        sizes = F.zip_with(found, between, lambda m, b: F.struct(_spaces(b).alias("gap"), _spaces(m).alias("words")))
        return F.when(F.size(found) > 0, F.filter(_scanned(sizes, F.lit(0), step, "struct<start:int,end:int>"),
                                                  lambda p: p["end"].isNotNull())).otherwise(
            F.array().cast("array<struct<start:int,end:int>>"))

    return F.transform(_let(F.regexp_extract_all(line, rule["regex"], F.lit(0)), spans), lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), rule["priority"].alias("priority"), rule["number"].alias("number"),
        rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")))


def _sweep(places: Column, beats) -> Column:
    """A flag for every place in turn: does a place seen before take precedence over it?

    The carry holds, for each priority, the reach of the places so far, so a
    text costs a step per place and no pairs of places.
    """
    levels = F.array(*[F.lit(None).cast("int") for _ in range(NOTICE)])
    return _scanned(places, levels, beats, "boolean")


def _forward(reach: Column, p: Column) -> tuple[Column, Column]:
    """Places by start, longest first: inside an earlier place of the same priority or above."""
    far = F.transform(reach, lambda x, i: F.when(i < p["priority"], F.greatest(x, p["end"])).otherwise(x))
    return far, F.coalesce(F.element_at(reach, p["priority"]) >= p["end"], F.lit(False))


def _backward(reach: Column, p: Column) -> tuple[Column, Column]:
    """Places by start, backwards: around a later place of higher priority."""
    near = F.transform(reach, lambda x, i: F.when(i < p["priority"], F.least(x, p["end"])).otherwise(x))
    return near, F.coalesce(F.get(reach, p["priority"]) <= p["end"], F.lit(False))


def surviving(places: Column) -> Column:
    """Places that no other one suppresses, by start.

    Of two places of which one contains the other, the one of lower priority
    goes; at equal priority the contained one goes, and of equal intervals
    the rule further down the list.
    """
    def compare(order):
        def by(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for key, sign in reversed(order):
                out = F.when(a[key] < b[key], -sign).when(a[key] > b[key], sign).otherwise(out)
            return out
        return by

    def unbeaten(forward: Column) -> Column:
        turned = F.reverse(F.zip_with(forward, _sweep(forward, _forward), lambda p, f: F.struct(p.alias("p"), f.alias("gone"))))
        return _let(turned, lambda t: F.reverse(F.transform(F.filter(
            F.zip_with(t, _sweep(F.transform(t, lambda x: x["p"]), _backward),
                       lambda x, f: F.struct(x["p"].alias("p"), (x["gone"] | f).alias("gone"))),
            lambda x: ~x["gone"]), lambda x: x["p"])))

    return _let(F.array_sort(places, compare([("start", 1), ("end", -1), ("priority", -1), ("number", 1)])), unbeaten)


def scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as doc (its columns but text), n_words, base (all places of base phrases), found.

    ``found`` are the surviving detections: word interval [start, end),
    priority, number and label of the rule, its confidence, and whether it is
    a base phrase. Rules run only in texts that hold one of their keywords as
    a word. A null or empty text has no words and no detections; rows that
    repeat, or have no id, are scanned like any other; an empty table gives
    an empty result. Each row is scanned in place: no shuffle, no Python.
    """
    table = rules()
    keywords = sorted({k for r in table for k in r["keywords"]})
    every = F.from_json(F.lit(json.dumps(table)), _RULE)
    worded = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc"),
                         words_of(docs["text"]).alias("words"))
    gated = worded.select("doc", F.size("words").cast("long").alias("n_words"),
                          F.array_intersect("words", F.array(*map(F.lit, keywords))).alias("hits"), "words")
    lined = gated.select("doc", "n_words", "hits", F.when(
        F.size("hits") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("line"))
    tried = F.filter(every, lambda r: F.arrays_overlap(r["keywords"], F.col("hits")))
    places = F.when(F.col("line").isNotNull(), F.flatten(F.transform(tried, lambda r: _places(F.col("line"), r))))
    empty = F.filter(F.array(F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("priority"), F.lit(0).alias("number"),
        F.lit("").alias("label"), F.lit(0.0).alias("confidence"), F.lit(False).alias("base"))), lambda p: p["base"])
    placed = lined.select("doc", "n_words", F.coalesce(places, empty).alias("places"))
    return placed.select("doc", "n_words", F.filter("places", lambda p: p["base"]).alias("base"),
                         F.when(F.size("places") > 0, surviving(F.col("places"))).otherwise(empty).alias("found"))
