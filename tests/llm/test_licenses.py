import random
import re

from pyspark.sql import functions as F

from setscope.llm import licenses
from setscope.llm.license_rules import BASE, rules

SCHEMA = "doc_id long, text string, words string, base int, found string"
RULES = rules()


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    """(words, base places, surviving (start, end, number)) by looking at all pairs of detections."""
    words = words_of(text)
    line = " " + " ".join(words) + " "
    found = [(line[:m.start()].count(" ") - 1, line[:m.end()].count(" "), r["priority"], r["number"], r["label"])
             for r in RULES if set(r["keywords"]) & set(words) for m in re.finditer(r["regex"], line)]

    def inside(a, b):
        return b[0] <= a[0] and a[1] <= b[1]

    def beaten(a):
        return any((inside(a, b) or inside(b, a)) and (b[2] > a[2] or (b[2] == a[2] and inside(a, b) and (
            not inside(b, a) or b[3] < a[3]))) for b in found if b is not a)

    base = sorted((i, label) for phrase, label in BASE for p in [phrase.split()]
                  for i in range(len(words)) if words[i:i + len(p)] == p)
    return len(words), base, sorted(a for a in found if not beaten(a))


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in enumerate(texts)], SCHEMA)
    got = licenses.scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        n, base, found = brute(texts[r.doc.doc_id])
        assert (r.n_words, sorted((p.start, p.label) for p in r.base)) == (n, base)
        assert sorted((p.start, p.end, p.priority, p.number, p.label) for p in r.found) == found
        assert (r.doc.words, r.doc.base, r.doc.found) == ("w", 1, "f")
    return got


def test_notices(spark):
    texts = {
        "Released under the MIT License.": {"mit"},
        "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
        "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0-or-later"},
        "GNU Lesser General Public License v2.1 and gplv3": {"lgpl-2.1", "gpl-3.0"},
        "Redistribution and use in source and binary forms, with or without modification": {"bsd"},
        "dedicated to the public domain under CC0 1.0 Universal": {"public-domain", "cc0-1.0"},
        "Mozilla Public License 2.0; Eclipse Public License v2; zlib license": {"mpl-2.0", "epl-2.0", "zlib"},
        "er kam mit der Lizenz, mit vielen Worten": set(),
        "nothing of the kind": set(),
    }
    got = check(spark, list(texts))
    for r in got:
        assert {p.label for p in r.found} == list(texts.values())[r.doc.doc_id], list(texts)[r.doc.doc_id]


def test_random_mixtures_against_all_pairs(spark):
    rnd = random.Random(9)
    parts = ["MIT License", "mit", "license", "Apache License", "version 2.0", "GNU", "general public", "License v3",
             "licensed under the", "or later", "CC BY-SA", "4.0", "Kit", "K license", "İ", "die ß é", ".", "all rights reserved",
             "BSD", "3-clause", "foo", "gpl 2.0 only", "mit license mit license", "public domain"]
    check(spark, [" ".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(150)])


def test_odd_rows_and_long_texts(spark):
    check(spark, [None, "", " .,;", "mit license " * 800, "word " * 60_000 + "general public license", "MIT LICENSE\x00mit\x7flicense"])
    df = spark.createDataFrame([(None, "mit license", "", 0, ""), (None, "mit license", "", 0, "")], SCHEMA)
    assert [(r.doc.doc_id, r.n_words, len(r.base)) for r in licenses.scan(df).collect()] == [(None, 2, 1)] * 2
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_are_many_and_plan_is_native(spark):
    assert len(RULES) >= 200 and len({r["label"] for r in RULES}) >= 80
    df = spark.createDataFrame([(1, "mit license", "", 0, "")], SCHEMA)
    plan = licenses.scan(df).groupBy(F.size("found")).count()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def example(rnd, regex):
    """A random text that an expression matches; some have two spaces in a row and match nothing."""
    out = regex.removeprefix("(?<= )").removesuffix("(?= )").replace(r"\S+", "q").replace(r"\d{4}", "2020").replace(r"\d", "7")
    out = re.sub(r"\[(\w+)\]", lambda m: rnd.choice(m[1]), out)
    while "(" in out:
        out = re.sub(r"\(\?:([^()]*)\)(\{\d,\d\}\??|\?)?", lambda m: rnd.choice(m[1].split("|")) * (
            rnd.randint(0, 1) if m[2] == "?" else rnd.randint(1, 3) if m[2] else 1), out)
    return re.sub(r"(.)\?", lambda m: m[1] * rnd.randint(0, 1), out)


def test_every_match_holds_a_keyword():
    rnd = random.Random(4)
    for r in RULES:
        lines = [f" {' '.join(words_of(example(rnd, r['regex'])))} " for _ in range(200)]
        found = [m[0] for line in lines for m in re.finditer(r["regex"], line)]
        assert found, r
        assert not [m for m in found if not set(m.split()) & set(r["keywords"])], r


def test_scan_agrees_without_the_keywords(spark, monkeypatch):
    """One example per rule; without the keywords every rule is tried in every text, as all hold "always"."""
    rnd = random.Random(5)
    texts = ["Expat license", "X Consortium license", "ASL 2.0", "APL 2.0", "FreeBSD license", "BSD zero clause license",
             "SPDX-License-Identifier: BSL-1.0", "PNG reference library license", "WTFPLv2", "PSF license",
             "University of Illinois open source license", "MS-PL", "MS-RL", "public domain dedication and license",
             "Unauthorized copying of this file", "see COPYING"]
    for r in RULES:
        texts.append(next(t for t in iter(lambda: example(rnd, r["regex"]), "") if re.search(
            r["regex"], f" {' '.join(words_of(t))} ")))
    df = spark.createDataFrame([(i, t + ". Always", "w", 1, "f") for i, t in enumerate(texts)], SCHEMA)
    gated = {r.doc.doc_id: r.found for r in licenses.scan(df).collect()}
    monkeypatch.setattr(licenses, "rules", lambda: [{**r, "keywords": ("always",)} for r in RULES])
    free = {r.doc.doc_id: r.found for r in licenses.scan(df).collect()}
    assert gated == free and all(free.values())


def test_many_matches_in_one_text(spark):
    """More places than a block holds, at odd distances."""
    parts = ["mit license", "x", "apache license version 2 0", "the general public license", "a b c", "bsd license"]
    rng = random.Random(5)
    check(spark, [" ".join(rng.choice(parts) for _ in range(n)) for n in (licenses.BLOCK, 3 * licenses.BLOCK, 1500)])
