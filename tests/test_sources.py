from pyspark.sql import functions as F

from setscope.sources.memberships import (
    code_domain, itemsets, memberships, registry, run_stats, sample_rows, subjects)

RAW = "subject_part string, subject_number string, code int, flag string"


def test_memberships_filters_nulls_flags_and_excluded(spark):
    raw = spark.createDataFrame([
        ("A", "1", 5, "I"), ("A", "1", 5, "I"), ("A", None, 5, "I"), ("B", "2", None, "I"),
        ("B", "2", 7, None), ("B", "2", 8, "I"), ("B", "2", 9, "X"), ("C", "3", 901, "I"),
        ("C", "3", 0, "I")], RAW)
    rows = sorted(tuple(r) for r in memberships(raw, ["subject_part", "subject_number"], "code", "flag").collect())
    # duplicates kept, NULL key/code/flag dropped, excluded codes dropped, other flags dropped
    assert rows == [("A1", 5), ("A1", 5)]


def test_excluded_only_subject_is_absent(spark):
    raw = spark.createDataFrame([("C", "3", 901, "I"), ("C", "3", 0, "I"), ("D", "4", 3, "I")], RAW)
    ids = {r.id for r in itemsets(memberships(raw, ["subject_part", "subject_number"], "code", "flag")).collect()}
    assert ids == {"D4"}


def test_registry_first_description_nulls_first_and_trimmed(spark):
    raw = spark.createDataFrame([
        (5, 2, "  second "), (5, None, " first  "), (5, 1, "third"), (6, 1, "b"), (6, 1, "a"),
        (None, 1, "x"), (8, 1, "excluded")], "code int, priority int, text string")
    reg = {r.archive: r.description for r in registry(raw, "code", ["priority"], "text").collect()}
    assert reg == {5: "first", 6: "a"}


def test_itemsets_and_subjects_count_duplicates(spark):
    m = spark.createDataFrame([("s", 3), ("s", 1), ("s", 3), ("s", 3), ("t", 2)], "id string, archive int")
    its = {r.id: r.archives for r in itemsets(m).collect()}
    assert its == {"s": [1, 3], "t": [2]}
    sub = {r.id: (r.archives, r.occurrences) for r in subjects(m).collect()}
    assert sub["s"] == ([1, 3], [1, 3])
    assert code_domain(m) == [1, 2, 3]
    st = run_stats(m).first()
    assert (st.sample_rows, st.sample_count, st.sample_archives_num) == (5, 2, 3)


def test_hash_sample_is_stable_under_repartitioning(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("archive"))
    a = {tuple(r) for r in sample_rows(df, 0.1, seed=3, keys=["id", "archive"]).collect()}
    b = {tuple(r) for r in sample_rows(df.repartition(13), 0.1, seed=3, keys=["id", "archive"]).collect()}
    assert a == b and 350 < len(a) < 650
    subj = sample_rows(df, 0.5, seed=1, keys=["id"])
    assert subj.count() < 5000


def test_read_table_by_path_and_by_catalog_name(spark):
    from setscope.sources.tables import read_table

    path = "/root/testdata/sf0.001/nation.parquet"
    by_path = read_table(spark, path)
    by_path.createOrReplaceTempView("nation_view_for_test")
    assert read_table(spark, "nation_view_for_test").count() == by_path.count() == 25


def test_seeded_bernoulli_sample_is_reproducible(spark):
    df = spark.range(20000)
    a = sorted(r.id for r in sample_rows(df, 0.05, seed=7).collect())
    b = sorted(r.id for r in sample_rows(df, 0.05, seed=7).collect())
    assert a == b and 700 < len(a) < 1300
