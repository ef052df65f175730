import random
import re

from setscope.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, key string, n_units string, places int"


def brute(rows, least):
    """{(doc_id, text): (kept text, removed spans)} by one pass in rank order (ids differ or rows repeat)."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        kept, spans, at = [], [], 0
        for line in [] if text is None else text.split("\n"):
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
            if norm and len(norm.split(" ")) >= least and norm in seen:
                spans.append((at, at + len(line)))
            else:
                kept.append(line)
            if norm and len(norm.split(" ")) >= least:
                seen.add(norm)
            at += len(line) + 1
        out[doc_id, text] = (text if text is None else "\n".join(kept), spans)
    return out


def check(spark, rows, least=3):
    df = spark.createDataFrame([(*r, "k", "n", 0) for r in rows], SCHEMA)
    got = dedup_lines(df, least).collect()
    want = brute(rows, least)
    texts = {(r[0]): r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc.doc_id]
        kept, spans = want[r.doc.doc_id, text]
        assert (r.text, [(s.start, s.end) for s in r.removed]) == (kept, spans)
        assert r.n_removed == len(spans)
        assert (r.doc.key, r.doc.n_units, r.doc.places) == ("k", "n", 0)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    lines = ["one two three", "ONE  two\tthree ", "a b", "", "é ü ß ñ", "É Ü ß Ñ", "x " * 400, "😀 two three four", "\r"]
    check(spark, [(i, "\n".join(rnd.choices(lines, k=rnd.randint(1, 9)))) for i in range(120)])


def test_nulls_repeats_and_empty_table(spark):
    rows = [(5, "p q r\nunique line here"), (5, "p q r\nunique line here"), (1, "p q r"), (None, "p q r\nlast"),
            (7, None), (8, ""), (9, "\n\n")]
    check(spark, rows)
    check(spark, [])


def test_hot_line_and_very_long_text(spark):
    hot = "the same line stands in every document here"
    rows = [(i, f"{hot}\nown line number {i}") for i in range(500)] + [(1000, "\n".join([hot, "w " * 20] * 5000))]
    check(spark, rows)
