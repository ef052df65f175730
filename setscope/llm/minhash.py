"""MinHash near-duplicates by tensored banding, with every link confirmed on the full shingle sets.

Two small collections of bands are computed for each text. A table's key is a
pair of one band of each collection, so ``BANDS`` squared tables cost only
2 x ``BANDS`` bands of minhashes. The tables that pair equal numbers come
first: in a few turns one text of each bucket meets those that are not yet in
its component, which makes groups of similar texts one component in few pairs.
All other tables are then worked on by buckets of the first collection alone,
in blocks: a task takes all pairs of two blocks that share a table and no
earlier bucket, and verifies those whose components still differ. So a pair
is verified once at most there, and never is a row between tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from setscope.llm.components import connected_components
from setscope.llm.joins import salted_join
from setscope.llm.text import chunks, release_worker_tables, split_words
from setscope.session import materialize, release_tables, tables_of

WIDTH = 5
#: Two texts are linked if so many hundredths of their union are common.
LEAST = 85
#: Bands of each of the two collections, and minhashes of a band. Texts at similarity s share a table with probability
#: (1 - (1 - s**ROWS)**BANDS)**2, which is above 0.9999 at 0.85.
BANDS = 22
ROWS = 6
SEED = 12
#: Number of the last turn of tables with one pivot a bucket.
LAST_TURN = 1
#: Texts that one pivot's set is compared with in one task.
PART = 512
#: Texts of a bucket, and bytes of their sets, that are one block: a task holds two.
BLOCK = 2048
BLOCK_BYTES = 8 << 20
#: Bytes of text worked on at once.
CHUNK = 2 << 20

_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (2, 2 * BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct word shingles of every text as sorted 64-bit hashes.

    A-Z in lower case; a text of fewer than ``width`` words is one shingle,
    one without words has none.
    """
    offsets, words = split_words(pc.ascii_lower(texts.fill_null("")))
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64,
                        len(coded.dictionary))
    hashed = known[coded.indices.to_numpy()] if len(known) else known
    number = np.diff(offsets)
    size = np.where(number > 0, np.maximum(number - width + 1, 1), 0)
    text = np.repeat(np.arange(len(number)), size)
    first = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    left = np.minimum(number[text], width)
    value = np.zeros(len(text), dtype=np.uint64)
    for i in range(width):
        there = left > i
        value[there] = _mixed(value[there] * _STEP + hashed[first[there] + i])
    value = _mixed(value ^ left.astype(np.uint64))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.concatenate((np.ones(min(len(text), 1), dtype=bool), (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
    value, text = value[new], text[new]
    return np.searchsorted(text, np.arange(len(number) + 1)), value


def band_values(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of every band (texts x 2 BANDS) of the sets given as [offsets[i], offsets[i+1]); no set may be empty."""
    bands = np.zeros((len(offsets) - 1, 2 * BANDS), dtype=np.uint64)
    for i in range(2 * BANDS):
        band = np.full(len(offsets) - 1, np.uint64(i + 1))
        for k in range(i * ROWS, (i + 1) * ROWS):
            least = np.minimum.reduceat(values * _FACTORS[0, k] + _FACTORS[1, k], offsets[:-1])
            band = _mixed(band * _STEP + least)
        bands[:, i] = band
    return bands


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text, node, n_shingles, one, two): set hash, set size and both collections of bands of every row.

    ``node`` is a 64-bit hash of the whole set: equal sets are one node. A
    text without words has a null node and no bands.
    """
    schema = StructType([docs.schema["doc_id"], StructField("text", StringType()), StructField("node", LongType()),
                         StructField("n_shingles", LongType()), StructField("one", ArrayType(LongType())),
                         StructField("two", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                offsets, values = shingle_sets(part.column("text"))
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                data = values.tobytes()
                node = np.zeros(len(size), dtype=np.uint64)
                node[full] = [xxhash.xxh3_64_intdigest(data[8 * offsets[i]:8 * offsets[i + 1]]) for i in full]
                bands = np.zeros((len(size), 2 * BANDS), dtype=np.uint64)
                if len(full):
                    bands[full] = band_values(np.append(offsets[:-1][full], offsets[-1]), values)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(b).view(np.int64).reshape(-1)), BANDS)
                         .cast(pa.list_(pa.int64())) for b in (bands[:, :BANDS], bands[:, BANDS:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(node.view(np.int64), mask=size == 0),
                     pa.array(size.astype(np.int64)), *lists], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of (key, node, ...) whose key another node has too."""
    keys = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    return salted_join(rows, keys, ["key"], F.col("node"), "left_semi")


def _buckets(sets: DataFrame, bands: DataFrame) -> DataFrame:
    """(key, node, turn): buckets of two or more nodes of the tables of equal numbers, one of those that hold the same nodes.

    Tables come in turns: a few first, then the others. Groups of similar
    texts are one component after the first, so most of their buckets need
    no work then.
    """
    turn = F.when(F.col("i") < 4, 0).otherwise(1)
    both = bands.join(sets.select("node", "two"), "node").select(
        "node", turn.alias("turn"), F.xxhash64("key", F.element_at("two", F.col("i") + 1)).alias("key"))
    rows = materialize(_shared(both), "tables")
    same = rows.groupBy("key").agg(F.min("turn").alias("turn"), F.count("*").alias("n"),
                                   F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"))
    kept = same.groupBy("n", "members").agg(F.min(F.struct("turn", "key")).alias("best")).select("best.key")
    return salted_join(rows, kept, ["key"], F.col("node"), "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The (pivot, member) pairs whose sets are similar enough, as (a, b).

    Every pivot's text goes once to each part of its members; a task reads
    its rows in order and holds the set of one pivot at a time.
    """
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = salted_join(pairs, parts, ["pivot"], F.col("member")).select(
        "pivot", F.pmod(F.xxhash64("member"), F.col("parts").cast("long")).cast("int").alias("part"), "member")
    members = dealt.join(texts, dealt["member"] == texts["node"]).select("pivot", "part", "member", "text")
    pivots = parts.join(texts, parts["pivot"] == texts["node"]).select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("member"), "text")
    rows = members.unionByName(pivots).repartition("pivot", "part").sortWithinPartitions(
        "pivot", "part", F.col("member").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for some in chunks(batch, "text", CHUNK):
                offsets, values = shingle_sets(some.column("text"))
                found = []
                for i, (pivot, member) in enumerate(zip(some.column("pivot").to_pylist(), some.column("member").to_pylist(),
                                                        strict=True)):
                    this = values[offsets[i]:offsets[i + 1]]
                    if member is None:
                        own = this.copy()
                        continue
                    at = np.minimum(np.searchsorted(own, this), len(own) - 1)
                    common = int((own[at] == this).sum())
                    if 100 * common >= least * (len(own) + len(this) - common):
                        found.append((pivot, member))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _alone(texts: DataFrame) -> DataFrame:
    """(node, own): how many of a node's shingles stand in no other of the (node, text) rows.

    A pair cannot have more in common than either side shares with anyone,
    which rules most pairs of changed copies out before their sets meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                offsets, values = shingle_sets(part.column("text"))
                node = np.repeat(part.column("node").to_numpy(), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(values.view(np.int64))], names=["node", "shingle"])

    held = texts.select("node", "text").mapInArrow(run, "node long, shingle long").groupBy("shingle").agg(
        F.min("node").alias("node"), F.max("node").alias("last"))
    return held.where("node = last").groupBy("node").agg(F.count("*").alias("own"))


def _open(rows: DataFrame, least: int) -> DataFrame:
    """The rows of (key, node, c, n, most, more) whose bucket holds two components, without those that have no partner there."""
    keys = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least_n")).where(
        "lo < hi").select("key", "least_n")
    # such a row cannot be near the smallest set of its bucket, nor a larger one
    return salted_join(rows, keys, ["key"], F.col("node")).where(
        100 * F.col("most") >= least * (F.greatest("least_n", "most") + F.col("n") - F.col("most"))).drop("least_n")


def _named(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows of (node, more) with c: their component so far."""
    if groups is None:
        return rows.withColumn("c", F.col("node"))
    return rows.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _united(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(node, component) by the (a, b) links and the components so far."""
    if groups is not None:
        links = links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return materialize(connected_components(links).select("node", "component"), "groups")


def _met(buckets: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(node, component) after the turns of the tables, of all nodes that a turn linked with another one.

    In a turn one node of every open bucket (one that holds two components)
    is its pivot: it meets all others that are not in its component. A turn
    gives back the tables of the one before.
    """
    spark, owner = buckets.sparkSession, f"minhash {uuid.uuid4().hex}"
    groups = None
    for number in range(LAST_TURN + 1):
        with tables_of(f"{owner} {number}"):
            named = materialize(_named(buckets.where(F.col("turn") <= number).drop("turn"), groups), "named")
            still = materialize(_open(named, least), "open")
            pivots = materialize(still.groupBy("key").agg(F.min(F.struct("node", "c", "n", "most")).alias("p")).select(
                "key", *(F.col(f"p.{c}").alias(a) for c, a in (("node", "pivot"), ("c", "pivot_c"), ("n", "pivot_n"), ("most", "pivot_most")))),
                "pivots")
            common = F.least("most", "pivot_most")
            met = salted_join(still, pivots, ["key"], F.col("node")).where(
                (F.col("c") != F.col("pivot_c")) & (100 * common >= least * (F.col("n") + F.col("pivot_n") - common)))
            # two pivots meet once; the one with the smaller node leads, so a pair has one form
            pairs = materialize(met.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("member"))
                                .distinct(), "pairs")
            groups = _united(_verified(pairs, texts, least), groups)
        release_tables(spark, f"{owner} {number - 1}")
    return groups


def _payload(texts: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text) rows: the 64-bit shingles of every set as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                offsets, values = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([values[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)],
                                                   pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def block_links(rows: pa.Table, least: int) -> list[tuple[int, int]]:
    """Links of all pairs of two blocks of one bucket of the first collection, as far as they join components.

    ``rows`` has band, side, node, c, n, most, one, two and shingles; side 0
    meets side 1, or itself where there is no other. A pair is left to the
    earliest band it shares, and has to share a band of the second collection.
    """
    column = {c: rows.column(c).to_numpy() for c in ("side", "node", "n", "most")}
    node, n, most = column["node"], column["n"], column["most"]
    one, two = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, BANDS) for c in ("one", "two"))
    band = rows.column("band")[0].as_py()
    _, label = np.unique(rows.column("c").to_numpy(), return_inverse=True)
    _, value = np.unique(np.frombuffer(b"".join(rows.column("shingles").to_pylist()), dtype=np.uint64), return_inverse=True)
    start = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(n)))
    mark = np.zeros(len(value) + 1, dtype=bool)
    lead, other = np.flatnonzero(column["side"] == 0), np.flatnonzero(column["side"] == 1)
    found = []
    for at, a in enumerate(lead):
        to = other if len(other) else lead[at + 1:]
        to = to[label[to] != label[a]]
        common = np.minimum(most[to], most[a])
        to = to[100 * common >= least * (n[to] + n[a] - common)]
        to = to[(two[to] == two[a]).any(axis=1)]
        to = to[~(one[to, :band] == one[a, :band]).any(axis=1)]
        if not len(to):
            continue
        own = value[start[a]:start[a + 1]]
        mark[own] = True
        end = np.cumsum(n[to])
        common = np.add.reduceat(mark[value[np.arange(end[-1]) + np.repeat(start[to] - end + n[to], n[to])]], end - n[to], dtype=np.int64)
        mark[own] = False
        for b in to[100 * common >= least * (n[to] + n[a] - common)]:
            if label[b] != label[a]:
                found.append((node[a], node[b]))
                label[label == label[b]] = label[a]
    return found


def _rest(bands: DataFrame, sets: DataFrame, sizes: DataFrame, texts: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """The (a, b) links of all tables between nodes whose components differ, enough of them to join what they link.

    Buckets of the first collection that hold the same open nodes are one,
    the earliest, where all their pairs belong. A large bucket is dealt into
    blocks, a component of more than a block into blocks of its own. Two
    blocks meet in one task, unless they are of one component.
    """
    rows = _named(bands.select("node", F.col("i").alias("band"), "key").join(sizes, "node"), groups)
    still = materialize(_open(materialize(rows, "named"), least), "open")
    filled = F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)
    same = still.groupBy("key").agg(
        F.min("band").alias("band"), F.count("*").alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi"),
        filled.alias("filled"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")).where("lo < hi")
    kept = same.groupBy("rows", "members").agg(F.min(F.struct("band", "key", "filled")).alias("best")).select("best.key", "best.filled")
    large = salted_join(still, kept.where("filled > 1").select("key"), ["key"], F.col("node"), "left_semi").groupBy("key", "c").agg(
        filled.alias("own")).where("own > 1")
    dealt = salted_join(still, kept, ["key"], F.col("node"))
    dealt = salted_join(dealt, large, ["key", "c"], F.col("node"), "left").withColumn("block", F.when(
        F.col("own").isNull(), F.pmod(F.xxhash64("c"), F.ceil("filled"))).otherwise(
        F.xxhash64("c", F.pmod(F.xxhash64("node"), F.ceil("own"))))).drop("own", "filled")
    dealt = materialize(dealt, "dealt")
    ends = dealt.groupBy("key", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    met = ends.select("key", F.col("block").alias("p"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi")).join(ends.select(
        "key", F.col("block").alias("q"), "lo", "hi"), "key").where("p <= q and least(lo, p_lo) < greatest(hi, p_hi)").select("key", "p", "q")
    places = met.select("key", F.col("p").alias("block"), "p", "q", F.lit(0).alias("side")).unionByName(
        met.where("p < q").select("key", F.col("q").alias("block"), "p", "q", F.lit(1).alias("side")))
    paired = materialize(dealt.join(places, ["key", "block"]).drop("block"), "paired")
    needed = paired.select("node").distinct()
    held = materialize(_payload(texts.join(needed, "node", "left_semi")), "shingles").join(sets.select("node", "one", "two"), "node")
    placed = paired.join(held, "node").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_tables()
        group, held = None, []

        def links() -> list[tuple[int, int]]:
            return block_links(pa.Table.from_batches(held), least) if held else []

        for batch in batches:
            found = []
            tags = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")], axis=1)
            begins = np.flatnonzero(np.concatenate((np.ones(min(len(tags), 1), dtype=bool), (tags[1:] != tags[:-1]).any(axis=1))))
            for begin, end in zip(begins, np.append(begins[1:], len(tags)), strict=True):
                if group != tuple(tags[begin]):
                    found += links()
                    group, held = tuple(tags[begin]), []
                held.append(batch.slice(begin, end - begin))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = links()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, more).

    Two rows are linked if 100 |A and B| >= ``least`` |A or B| for their sets
    of distinct five-word shingles; component_id is the smallest doc_id that
    links lead to, and kept says that it is the row's own. A null or empty
    text, or one without words, has size 0 and is linked with nothing. A
    null doc_id names no component unless all ids of it are null (then null,
    and kept). Rows that repeat stay and are linked; an empty table gives an
    empty result; other columns play no part. Copies are one node from the
    start, combined map-side, and meet their labels under a salt.
    """
    marked = materialize(signatures(docs), "signatures")
    full = marked.where(F.col("node").isNotNull())
    sets = materialize(full.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
                                                F.first("one").alias("one"), F.first("two").alias("two")), "sets")
    bands = materialize(_shared(sets.select("node", F.posexplode("one").alias("i", "key"))), "bands")
    # the text of every node that shares a band, once
    texts = materialize(salted_join(full, bands.select("node").distinct(), ["node"], F.col("doc_id"), "left_semi").groupBy(
        "node").agg(F.first("text").alias("text")), "texts")
    sizes = materialize(sets.select("node", F.col("n_shingles").alias("n")).join(texts.select("node"), "node").join(
        _alone(texts), "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most")), "sizes")
    groups = _met(materialize(_buckets(sets, bands).join(sizes, "node"), "buckets"), texts, least)
    groups = _united(_rest(bands, sets, sizes, texts, groups, least), groups)
    labels = sets.select("node", "first_id").join(groups, "node", "left").select(
        "node", "first_id", F.coalesce("component", "node").alias("component"))
    firsts = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labels.join(firsts, "component").select("node", "component_id")
    linked = salted_join(full.select("doc_id", "node", "n_shingles"), named, ["node"], F.col("doc_id")).select(
        "doc_id", "n_shingles", "component_id")
    alone = marked.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
