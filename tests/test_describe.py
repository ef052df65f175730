from setscope.functions.text import segment_text
from setscope.operators.describe import describe_array, describe_code, segment_rows, tag


def _registry(spark):
    return spark.createDataFrame([(6, "d6"), (9, "d9")], "archive int, description string")


def test_describe_array_format_order_and_missing(spark):
    df = spark.createDataFrame([([9, 6], [6]), ([6, 7], []), (None, [9])], "a array<int>, b array<int>")
    out = describe_array(df, ["a", "b"], _registry(spark)).collect()
    got = {(r.a_description, r.b_description) for r in out}
    # array order kept, a code without description shows the bare code, empty gives []
    assert got == {("[9: d9, 6: d6]", "[6: d6]"), ("[6: d6, 7]", "[]"), (None, "[9: d9]")}


def test_describe_code_left_join(spark):
    df = spark.createDataFrame([(6,), (7,)], "archive int")
    got = {r.archive: r.archive_description for r in describe_code(df, _registry(spark)).collect()}
    assert got == {6: "d6", 7: None}


def test_segment_text_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, "abcdef"), (3, "ab"), (4, "abcdefg"), (5, None)],
                               "k int, text string")
    counts = {r.k: len(r.s) for r in df.select("k", segment_text("text", 3).alias("s")).collect()}
    assert counts == {1: 0, 2: 2, 3: 1, 4: 3, 5: 0}
    rows = segment_rows(df, "k", "text", 3).filter("k = 4").orderBy("index").collect()
    assert "".join(r.content for r in rows) == "abcdefg" and [r["index"] for r in rows] == [0, 1, 2]


def test_tag(spark):
    row = tag(spark.range(1), analysis_type="raw", model_type="kmeans").first()
    assert (row.analysis_type, row.model_type) == ("raw", "kmeans")
