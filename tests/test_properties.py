"""Property tests: Spark operators against plain-Python references on random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from setscope.functions.text import segment_text
from setscope.operators.describe import describe_array
from setscope.sources.results import upsert_by_key

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=6), length=st.integers(1, 9))
def test_segments_reassemble_whole_texts(spark, texts, length):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    got = {r.k: r.s for r in df.select("k", segment_text("text", length).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [t[j:j + length] for j in range(0, len(t), length)]


@SETTINGS
@given(old=st.dictionaries(st.text("abc", min_size=1, max_size=2), st.text("xyz", max_size=2), max_size=6),
       new=st.dictionaries(st.text("abc", min_size=1, max_size=2), st.text("xyz", max_size=2), max_size=6))
def test_upsert_equals_dict_update(spark, old, new):
    schema = "key string, value string"
    merged = upsert_by_key(spark.createDataFrame(list(old.items()), schema),
                           spark.createDataFrame(list(new.items()), schema), ["key"])
    assert {r.key: r.value for r in merged.collect()} == {**old, **new}


@SETTINGS
@given(rows=st.lists(st.lists(st.integers(0, 6), max_size=4), min_size=1, max_size=6),
       reg=st.dictionaries(st.integers(0, 6), st.text("pq", min_size=1, max_size=3), max_size=7))
def test_describe_array_matches_python_format(spark, rows, reg):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, a array<int>")
    registry = spark.createDataFrame(list(reg.items()), "archive int, description string")
    got = {r.k: r.a_description for r in describe_array(df, ["a"], registry).collect()}
    for i, r in enumerate(rows):
        expected = "[" + ", ".join(f"{c}: {reg[c]}" if c in reg else str(c) for c in r) + "]"
        assert got[i] == expected
