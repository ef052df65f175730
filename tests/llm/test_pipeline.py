import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute
from test_mixing import drawn, targets
from test_packing import ids_of
from test_simhash import components, fingerprint

import __spark_entry__ as E
import corpus_pipeline as P
from setscope.llm import catalog, language_id, mixing
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(P.STAGES)


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(900_000, "12 34 ?!", "en", "src1", 8), (900_001, None, None, "src1", None), (900_002, "", "de", None, 0),
             (None, "Und der die von zu und mit der", None, "src2", 30)]
    return docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_stages_and_their_order():
    assert [name for name, _ in P.STAGES] == ["language_id", "simhash", "line_dedup", "mixing", "packing"]
    assert E.queries()["pipeline"] is P.run and len([q for q in E.queries() if re.match(r"op\d+_", q)]) == 13


def test_language_stage_keeps_documents_with_a_language(spark, documents):
    out = STAGES["language_id"](spark, documents, SF)
    assert out.columns == COLUMNS
    kept = rows(out)
    verdict = language_id.identify(documents, keep_text=True).select("doc.*", "text", "lang_pred", "score").collect()
    want = [(r.doc_id, r.text, r.lang or r.lang_pred, r.source, r.n_chars) for r in verdict
            if r.lang_pred != "und" and r.score >= 0.5]
    assert kept == sorted(want, key=repr)
    gone = {r[0] for r in rows(documents)} - {r[0] for r in kept}
    assert {900_000, 900_001, 900_002} <= gone and len(gone) < 10


def test_language_stage_drops_only_texts_without_a_letter(spark, documents):
    short = [(910_000 + i, t, None, "src1", len(t)) for i, t in enumerate(["vr", "Mr", "Ж", "12", "vs. 3"])]
    given = documents.unionByName(spark.createDataFrame(short, documents.schema))
    least = language_id.identify(given, keep_text=True).where("doc.doc_id >= 910000 and lang_pred <> 'und'").agg(F.min("score"))
    assert least.first()[0] < 0.5
    gone = {r[0] for r in rows(given)} - {r[0] for r in rows(STAGES["language_id"](spark, given, SF))}
    assert gone == {900_000, 900_001, 900_002, 910_003}


def test_simhash_stage_keeps_the_first_of_each_group(spark, documents):
    out = STAGES["simhash"](spark, documents, SF)
    assert out.columns == COLUMNS
    given = rows(documents)
    fps = {r[0]: fingerprint(r[1]) for r in given}
    root = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for r in given:
        key = root[fps[r[0]]]
        if key not in first or (r[0] is None, r[0] or 0) < (first[key][0] is None, first[key][0] or 0):
            first[key] = r
    assert rows(out) == sorted(first.values(), key=repr)


def test_line_stage_removes_later_lines(spark, documents):
    out = STAGES["line_dedup"](spark, documents, SF)
    assert out.columns == COLUMNS
    given = rows(documents)
    kept = brute([r[:2] for r in given], 1)
    want = []
    for doc_id, text, lang, source, n in given:
        new, spans = kept[doc_id, text]
        want.append((doc_id, new, lang, source, len(new) if spans else n))
    assert rows(out) == sorted(want, key=repr)


def test_mix_stage_repeats_documents(spark, documents):
    out = STAGES["mixing"](spark, documents, SF)
    given = rows(documents)
    size = {}
    for r in given:
        size[r[3]] = size.get(r[3], 0) + sizes(r[1])
    goal = targets(size)
    exact = {r.source: r.target for r in mixing.mixing_plan(documents).select("doc.source", "target").collect()}
    assert all(math.isclose(exact[s], goal[s], rel_tol=1e-9) for s in goal)
    copies = Counter()
    for doc_id, n, source, k in drawn([(r[0], sizes(r[1]), r[3]) for r in given], exact, size):
        copies[doc_id, n, source] += k
    took = Counter((r[0], sizes(r[1]), r[3]) for r in rows(out))
    assert took == +copies and set(rows(out)) <= set(given)
    assert out.columns == COLUMNS


def test_packing_stage_and_the_whole_run(spark):
    """run() equals its stages one after the other; the last one's pieces hold the mixed texts whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    out = P.run(spark, SF).collect()
    want = []
    for r in docs.collect():
        ids = np.array(ids_of(r.text), dtype="<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want.append((r.doc_id, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())))
    assert sorted((tuple(r)[:5] for r in out)) == sorted(want)
    filled = {}
    for r in out:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_of_an_empty_table(spark, documents):
    empty = documents.limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == COLUMNS and out.count() == 0
    assert STAGES["packing"](spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_match_their_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute(f"CREATE VIEW twin AS {catalog.ORACLES[name]}")
    res = con.execute("SELECT * FROM twin")
    columns = [d[0] for d in res.description]
    got = catalog.QUERIES[name](spark, SF)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, res.fetchall())


def test_query_columns_and_types(spark):
    want = {"op2_mixing": {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
            "op3_html": {"text": "string", "n_chars": "bigint"}, "op4_simhash": {"fingerprint": "string", "component_id": "bigint"},
            "op5_language_id": {"held_out": "boolean", "lang_pred": "string", "score": "double"},
            "op6_packing": {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                            "sequence_id": "bigint", "offset": "bigint"},
            "op7_quality": {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                            "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
            "op8_licenses": {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
                             "base_labels": "string", "labels": "string", "score": "double"},
            "op9_toxicity": {"held_out": "boolean", "score": "double", "predicted": "int"},
            "op10_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}}
    for name, columns in want.items():
        got = dict(catalog.QUERIES[name](spark, SF).dtypes)
        assert columns.items() <= got.items(), name
