import uuid

from setscope.session import ensure_checkpoint_dir
from setscope.sources.results import read_result, save_upsert, upsert_by_key, write_result

KV = "key string, value string"


def test_upsert_empty_store_and_overlay(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2")], KV)
    assert sorted(tuple(r) for r in upsert_by_key(None, new, ["key"]).collect()) == [("a", "1"), ("b", "2")]
    old = spark.createDataFrame([("a", "0"), ("c", "3")], KV)
    got = sorted(tuple(r) for r in upsert_by_key(old, new, ["key"]).collect())
    assert got == [("a", "1"), ("b", "2"), ("c", "3")]


def test_save_upsert_first_run_and_rewrite_same_path(spark):
    path = f"{ensure_checkpoint_dir(spark)}/info-{uuid.uuid4().hex}"
    save_upsert(spark, spark.createDataFrame([("a", "1")], KV), path, ["key"], schema=KV)
    save_upsert(spark, spark.createDataFrame([("a", "2"), ("b", "3")], KV), path, ["key"], schema=KV)
    got = sorted(tuple(r) for r in read_result(spark, path, schema=KV).collect())
    assert got == [("a", "2"), ("b", "3")]


def test_upsert_keeps_stored_columns_and_one_row_per_key(spark):
    old = spark.createDataFrame([("a", "0", "note a"), ("c", "3", "note c")], "key string, value string, note string")
    new = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "9", 1)], "key string, value string, at int")
    got = {r.key: (r.value, r.note, r.at) for r in upsert_by_key(old, new, ["key"], ["at"]).collect()}
    assert got == {"a": ("2", "note a", 2), "b": ("9", None, 1), "c": ("3", "note c", None)}
    first = upsert_by_key(None, new, ["key"], ["at"]).collect()
    assert sorted(tuple(r) for r in first) == [("a", "2", 2), ("b", "9", 1)]


def test_broken_swap_is_recovered(spark):
    """A crash between the two renames leaves only the old folder; the next upsert starts from it."""
    import os

    path = f"{ensure_checkpoint_dir(spark)}/info-{uuid.uuid4().hex}"
    save_upsert(spark, spark.createDataFrame([("a", "1")], KV), path, ["key"], schema=KV)
    local = path.removeprefix("file:")
    os.rename(local, local + ".old")
    save_upsert(spark, spark.createDataFrame([("b", "2")], KV), path, ["key"], schema=KV)
    assert sorted(tuple(r) for r in read_result(spark, path, schema=KV).collect()) == [("a", "1"), ("b", "2")]


def test_ordered_reports_read_back_in_order(spark):
    """Files hold ranges of the order: by file name, frequencies only fall."""
    from conftest import SF_SMALL
    from pyspark.sql import functions as F
    from setscope.operators.mining import rules_report
    from setscope.sources import bindings as B
    from setscope.sources.memberships import itemsets

    m, reg = B.order_parttype(spark, SF_SMALL)
    for name, col in (("frequencies", "freq"), ("confidences", "confidence")):
        path = f"{ensure_checkpoint_dir(spark)}/ordered-{uuid.uuid4().hex}"
        write_result(rules_report(itemsets(m), reg)[name], path)
        rows = read_result(spark, path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), col)
        values = [r[col] for r in sorted(rows.collect(), key=lambda r: (r.f, r.i))]
        assert len(values) > 3 and values == sorted(values, reverse=True)


def test_orc_round_trip_partitioned(spark):
    path = f"{ensure_checkpoint_dir(spark)}/res-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, 5, "raw", "kmeans"), (2, 6, "pca", "hierarchical")],
                               "cluster int, archive int, analysis_type string, model_type string")
    write_result(df, path, partition_by=("model_type", "analysis_type"))
    back = read_result(spark, path)
    assert sorted(tuple(r[c] for c in df.columns) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert read_result(spark, path + "-missing", missing_ok=True) is None


def test_upsert_with_composite_key(spark):
    schema = "k1 string, k2 int, value string"
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], schema)
    new = spark.createDataFrame([("a", 2, "z"), ("b", 1, "w")], schema)
    got = sorted(tuple(r) for r in upsert_by_key(old, new, ["k1", "k2"]).collect())
    assert got == [("a", 1, "x"), ("a", 2, "z"), ("b", 1, "w")]


def test_store_rewrites_only_buckets_with_changed_keys(spark):
    import glob
    import uuid

    from setscope.session import ensure_checkpoint_dir
    from setscope.sources.buckets import read_store, upsert_store

    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    files = lambda: {f: open(f, "rb").read() for f in glob.glob(path.removeprefix("file:") + "/_bucket=*/*.orc")}
    assert read_store(spark, path) is None
    first = spark.createDataFrame([(i, f"v{i}", i * 2) for i in range(200)], "key long, value string, kept int")
    assert upsert_store(spark, first, path, ["key"], buckets=16) == 16
    before = files()
    new = spark.createDataFrame([(7, "new", 1.5), (900, "more", 2.5), (900, "more", 2.5)], "key int, value string, extra double")
    written = upsert_store(spark, new.withColumn("key", new["key"].cast("long")), path, ["key"], buckets=16)
    after = files()
    folder = lambda f: f.split("/")[-2]
    changed = {folder(f) for f in after.keys() - before.keys()}
    assert written == len(changed) <= 2
    assert {f: b for f, b in before.items() if folder(f) not in changed} == {
        f: b for f, b in after.items() if folder(f) not in changed}
    rows = {r.key: (r.value, r.kept, r.extra) for r in read_store(spark, path).collect()}
    assert len(rows) == 201 and rows[7] == ("new", 14, 1.5) and rows[900] == ("more", None, 2.5) and rows[8] == ("v8", 16, None)
    assert upsert_store(spark, new.limit(0), path, ["key"], buckets=16) == 0 and files() == after
