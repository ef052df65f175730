import hashlib
import math
import re

from pyspark.sql import functions as F

from setscope.llm import catalog, mixing

SCHEMA = "doc_id long, text string, source string, size long, copies string"


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share-out in rounds: give by weight, stop what is above its limit, share the excess."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    done, total = {}, sum(sizes.values())
    while len(done) < len(names):
        left = total - sum(done.values())
        free = [n for n in names if n not in done]
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n]]
        if not over:
            return done | share
        done |= {n: most * sizes[n] for n in over}
    return done


def coin(text):
    return int(hashlib.md5(f"mix:{text}".encode()).hexdigest()[:8], 16) / 2**32


def drawn(docs, want, size):
    """Copies of each (id, words, source), one document of a source after the other, largest first."""
    out = []
    for source, total in size.items():
        name = "n" if source is None else f"s{source}"
        rate = min(want[source] / total, 3) if total else 0.0
        whole, fraction = math.floor(rate), rate - math.floor(rate)
        rows = sorted((-n, coin("" if i is None else i), i is not None, i or 0) for i, n, s in docs if s == source)
        first = [r for r in rows if -r[0] * 64 > total]
        draw = lambda u, f, place: math.floor(u + f * place) - math.floor(u + f * (place - 1))
        more = [draw(coin(f"first:{name}"), fraction, p) for p in range(1, len(first) + 1)]
        others = -sum(r[0] for r in rows[len(first):])
        owes = fraction * -sum(r[0] for r in first) + sum(m * r[0] for m, r in zip(more, first))
        second = fraction + owes * min(1.0 / others, min(fraction, 1.0 - fraction) / -rows[0][0]) if others else fraction
        assert 0 <= second <= 1
        more += [draw(coin(f"others:{name}"), second, p) for p in range(1, len(rows) - len(first) + 1)]
        out += [(r[3] if r[2] else None, -r[0], source, whole + m) for r, m in zip(rows, more)]
    return out


def test_against_brute_force(spark):
    docs = [(i, "w " * (i * 37 % 91), ["a", "b", "Z", "é", None, "tiny", ""][i * i % 7]) for i in range(400)]
    docs += [(i, "same size", "a") for i in range(1000, 3000)]
    docs += [(9, "same id", "a"), (9, "same id", "a"), (None, "no id", "b"), (500, None, "tiny"), (501, "x", "Ω")]
    df = spark.createDataFrame([(*d, -1, "clash") for d in docs], SCHEMA)
    got = mixing.mixing_plan(df).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").collect()
    counted = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in docs]
    size = {}
    for _, n, s in counted:
        size[s] = size.get(s, 0) + n
    want = targets(size)
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        rate = min(r.target / r.source_size, 3) if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.floor(rate) + 1 and r.copies <= 3
    exact = {r.source: r.target for r in got}
    by = lambda rows: sorted(map(repr, rows))
    assert by((r.doc_id, r.size, r.source, r.copies) for r in got) == by(drawn(counted, exact, size))
    assert math.isclose(sum(want.values()), sum(size.values()))


def test_taken_words_are_near_every_target(spark):
    sf = "/root/testdata/sf0.1"
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    rows = catalog.op2_mixing(spark, sf).join(source, "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("n")).collect()
    assert len(rows) == 20 and all(abs(r.n - r.target) <= 0.05 * r.target for r in rows)


def test_chance_of_a_copy_is_the_fraction(spark):
    """The same documents under many sources, so with many starts: each is drawn as often as the fraction says."""
    most = 400
    sizes = {"a": [900] + [10 + i for i in range(80)], "b": [300] + [10 + i for i in range(40)]}
    docs = spark.createDataFrame([(most * i + r, "w " * n, f"{name}{r}", i, "") for name, all_ in sizes.items()
                                  for i, n in enumerate(all_) for r in range(most)], SCHEMA)
    out = mixing.mixing_plan(docs, weights=(1,)).groupBy(
        F.substring(F.col("doc")["source"], 1, 1).alias("name"), F.col("doc")["size"].alias("i")).agg(
        F.avg("copies").alias("mean"), F.first(F.col("target") / F.col("source_size")).alias("rate")).collect()
    assert {r.name: r.rate for r in out}["a"] < 1 < {r.name: r.rate for r in out}["b"]
    # 400 draws: four standard deviations are at most 0.1
    assert len(out) == 122 and all(abs(r["mean"] - r["rate"]) < 0.1 for r in out)


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s%d" % (i % 2), 7, "x") for i in range(1000)], SCHEMA)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    per = {r.source: r.n for r in out.groupBy("source").agg((F.count("*") * 4).alias("n")).collect()}
    assert abs(per["s0"] - 4000 * 5 / 7) < 250 and abs(per["s1"] - 4000 * 2 / 7) < 250


def test_empty_tables_and_texts(spark):
    assert mixing.mixing_plan(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, None, 0, ""), (2, "", "a", 0, "")], SCHEMA)
    assert [(r.target, r.copies) for r in mixing.mixing_plan(only).collect()] == [(0.0, 0), (0.0, 0)]
