import random
import re

from setscope.llm.line_dedup import dedup_lines
from setscope.llm.passage_dedup import dedup_passages

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least):
    """{doc_id: (kept text, removed spans, words)} by one pass in rank order over every run of words (ids differ or rows repeat)."""
    first, out = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        low = [w.group().lower() for w in words]
        gone = set()
        for at in range(len(low) - least + 1):
            run = tuple(low[at:at + least])
            seen = first.setdefault(run, (doc_id, at))
            if seen[0] != doc_id or at >= seen[1] + least:
                gone |= set(range(at, at + least))
        spans = []
        for i in sorted(gone):
            if i - 1 not in gone:
                last = next(k for k in range(i, len(words)) if k + 1 not in gone)
                start, end = words[i].start(), words[last].end()
                if start == 0 or text[start - 1] == "\n":
                    end = words[last + 1].start() if last + 1 < len(words) else end
                else:
                    start = words[i - 1].end() if i else start
                spans.append((start, end))
        kept = text
        for start, end in reversed(spans):
            kept = kept[:start] + kept[end:]
        out[doc_id] = (kept, spans, len(gone))
    return out


def check(spark, rows, least):
    got = dedup_passages(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA), least).collect()
    want = brute(rows, least)
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, [(s.start, s.end) for s in r.removed], r.n_removed) == want[r.doc.doc_id]
        assert r.doc.lang == "en"
    return got


def prose(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_passages_inside_lines_go_and_short_lines_stay(spark):
    rnd = random.Random(1)
    passage, short = prose(rnd, 60), " ".join(prose(rnd, 20))
    rows = [(i, "\n".join([short, " ".join(prose(rnd, 5) + passage + prose(rnd, 5)), " ".join(prose(rnd, 9))])) for i in range(6)]
    rows += [(50 + i, "\n".join([short, " ".join(prose(rnd, 70))])) for i in range(4)]
    rows += [(90, " ".join(prose(rnd, 3) + passage[:50])), (91, " ".join(prose(rnd, 3) + passage[9:])),
             (92, "\t".join(w.upper() for w in passage) + "\n\nlast")]
    got = {r.doc.doc_id: r for r in check(spark, rows, 51)}
    assert {i for i, r in got.items() if r.n_removed} == {1, 2, 3, 4, 5, 91, 92}
    by_line = {r.doc.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)).collect()}
    assert by_line[91] == 0 and by_line[50] == 1


def test_against_brute_force(spark):
    rnd = random.Random(7)
    pool = [[rnd.choice(["a", "B", "ü", "Ü", "😀", "É"]) for _ in range(rnd.randint(1, 9))] for _ in range(12)]
    gaps = [" ", "\n", " \t ", "\n\n", "\r\n"]

    def text():
        words = [w for _ in range(rnd.randint(0, 8)) for w in rnd.choice(pool)]
        return rnd.choice(["", " ", "\n"]) + "".join(w + rnd.choice(gaps) for w in words)

    for least in (1, 2, 5, 8):
        check(spark, [(i, text()) for i in range(80)], least)


def test_nulls_repeats_and_empty_table(spark):
    long = " ".join(f"p{i}" for i in range(55))
    check(spark, [(5, long), (5, long), (1, "x " * 400), (None, "own " + long), (7, None), (8, ""), (9, "\n\n"), (10, "x " * 60)], 51)
    check(spark, [], 51)


def test_hot_passage_and_very_long_text(spark):
    rnd = random.Random(3)
    hot = " ".join(prose(rnd, 60))
    rows = [(i, " ".join([*prose(rnd, 3), hot, *prose(rnd, 3)])) for i in range(400)]
    rows.append((1000, "\n".join([" ".join(prose(rnd, 40_000)), hot, "w " * 3000])))
    got = {r.doc.doc_id: r for r in check(spark, rows, 51)}
    assert got[399].n_removed == 60 and got[0].n_removed == 0
