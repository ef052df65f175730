import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from setscope.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n int, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for w in ([x for x in re.split("[ \t]+", p) if x] for p in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(LOWER))) if w]


def brute(rows, threshold, top=2000):
    f = Counter()
    for _, text, lang in rows:
        for words in pieces(text or ""):
            for k in range(1, 5):
                f.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    cand = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= threshold}
    inside = lambda p, q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for lang in {lang for lang, _ in f}:
        n = sum(a for (own, p), a in f.items() if own == lang and len(p) == 1)
        mine = {p: a for (own, p), a in cand.items() if own == lang}
        best = []
        for p, a in mine.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= 80 * a for q, b in mine.items()):
                continue
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def check(spark, rows, threshold=5, top=2000, parts=3):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(parts)
    got = C.collocations(df, threshold, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, threshold, top)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "é", "ΔX", "naïve", "x", "the", "OF", "zz9", "ünder"]
    fixed = ["the alpha OF beta", "x x x x", "naïve é", "ΔX zz9 ünder"]
    gap = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", " \r\n", "; ", "!?", "\x0b"]
    for i in range(n):
        text = "".join((rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words)) + rnd.choice(gap) for _ in range(rnd.randrange(40)))
        yield i, text, rnd.choice(["en", "de", None, "und"])


@pytest.mark.parametrize("bits", [25, 6])
def test_against_brute_force_also_when_filters_say_yes_too_often(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "FILTER_BITS", bits)
    check(spark, list(corpus(bits)))


def test_ties_at_the_limit_and_other_shards(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARDS", 1)
    check(spark, list(corpus(2, 60)), threshold=3, top=7)
    monkeypatch.setattr(C, "SHARDS", 5)
    check(spark, list(corpus(3, 60)), threshold=4, top=3, parts=1)


def test_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " .,;\n", "en"), (None, "a b a b a b", None), (4, "a b" * 400, "en"),
            (4, "a b" * 400, "en"), (5, "K a K a K a K a", "en"), (6, "end", "xx"), (6, "start", "xx")]
    check(spark, rows)
    check(spark, [])
    check(spark, rows[:3])


def test_a_phrase_never_spans_texts_or_pieces():
    out = C.normalised(pa.array(["A b. c", None, "", " d\t e ,", "f"])).to_pylist()
    assert out == ["a b\nc\n", "", "", "d e\n", "f\n"]
