"""Stand-in inputs built from the TPC-H-like test tables.

These only shape rows into the schemas the jobs read (the reference's raw
membership and registry tables, dense points, texts); all analysis work is
done by the operators on whatever rows arrive.

* B1 order x supplier nation: subject = customer key || order key (both
  zero-padded to 10), code = supplier nation, flag = line status ("O" kept).
* B2 order x part type: subject = order key, code = part type (strings).
* B3 dense points: embedding vectors with their given label.
* B4 texts: documents.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.options import EXCLUDED_CODES
from setscope.sources.memberships import memberships, registry
from setscope.sources.tables import test_table

B1_FLAG = "O"


def _pad(col: str):
    return F.lpad(F.col(col).cast("string"), 10, "0")


def order_nation_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw membership table (subject_part, subject_number, code, flag) for B1."""
    li = test_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus")
    od = test_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    su = test_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .join(su, li.l_suppkey == su.s_suppkey)
            .select(_pad("o_custkey").alias("subject_part"), _pad("o_orderkey").alias("subject_number"),
                    F.col("s_nationkey").alias("code"),
                    F.col("l_linestatus").alias("flag")))


def order_nation_registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw registry (code, priority, text) for B1."""
    return test_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("priority"),
        F.col("n_name").alias("text"))


def order_nation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(memberships, registry) of binding B1."""
    m = memberships(order_nation_raw(spark, sf_dir), ["subject_part", "subject_number"], "code",
                    "flag", B1_FLAG, EXCLUDED_CODES)
    r = registry(order_nation_registry_raw(spark, sf_dir), "code", ["priority"],
                 "text", EXCLUDED_CODES)
    return m, r


def order_parttype_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = test_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pa = test_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(pa, li.l_partkey == pa.p_partkey).select("l_orderkey", "p_type")


def part_type_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of B2: first ``p_brand || ' ' || p_name`` per type by (brand, name)."""
    pa = test_table(spark, sf_dir, "part")
    return registry(pa, "p_type", ["p_brand", "p_name"],
                    F.concat_ws(" ", "p_brand", "p_name"), excluded=())


def order_parttype(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(memberships, registry) of binding B2."""
    m = memberships(order_parttype_raw(spark, sf_dir), ["l_orderkey"], "p_type", excluded=())
    return m, part_type_registry(spark, sf_dir)


def order_rule_clusters(spark: SparkSession, sf_dir: str, binding: str = "B1",
                        n: int = 3) -> DataFrame:
    """(id, cluster) with cluster = order key mod n: a given assignment SQL can repeat."""
    od = test_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if binding == "B1":
        subject = F.concat(_pad("o_custkey"), _pad("o_orderkey"))
    else:
        subject = F.col("o_orderkey").cast("string")
    return od.select(subject.alias("id"), (F.col("o_orderkey") % n).cast("int").alias("cluster"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features vector, cluster) of binding B3."""
    em = test_table(spark, sf_dir, "embeddings")
    return em.select(F.col("vec_id").cast("string").alias("id"),
                     array_to_vector(F.col("embedding")).alias("features"),
                     F.col("label").cast("int").alias("cluster"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_table(spark, sf_dir, "documents").select("doc_id", "text")
