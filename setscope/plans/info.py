"""Run metadata (``info`` dataset: key, value), upserted across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.options import Options
from setscope.sources.memberships import run_stats


def parameter_rows(spark: SparkSession, opts: Options, data_table: str = "", registry_table: str = "",
                   saving_path: str = "", sample_fraction: float = 1.0) -> DataFrame:
    """(key, value) rows of the job parameters, values as text.

    ``sample_fraction`` is the fraction that was applied. The database name is
    the part of ``data_table`` before the dot.
    """
    # fixed values: the keys are the output contract of the info dataset
    params = {
        "saving_path": saving_path, "db_name": data_table.rpartition(".")[0], "data_table": data_table,
        "registry_table": registry_table, "sample_data_table": sample_fraction, "K": opts.big_k,
        "lower_k": opts.k_low, "upper_k": opts.k_high, "lower_t": opts.t_low, "upper_t": opts.t_high,
        "optimal_k_raw": opts.opt_k_raw, "optimal_k_pca": opts.opt_k_pca,
        "optimal_t_raw": opts.opt_t_raw, "optimal_t_pca": opts.opt_t_pca,
        "top_trend_vectors": opts.top_itemsets, "variance_lower_perc": opts.variance_low,
        "variance_upper_perc": opts.variance_high, "n_loadings": opts.n_loadings,
    }
    return spark.createDataFrame([(k, str(v)) for k, v in params.items()], "key string, value string")


def stats_rows(members: DataFrame) -> DataFrame:
    """(key, value) rows of the sample counts: subjects and distinct codes."""
    st = run_stats(members)
    return st.select(F.explode(F.array(
        F.struct(F.lit("sample_count").alias("key"), F.col("sample_count").cast("string").alias("value")),
        F.struct(F.lit("sample_archives_num").alias("key"),
                 F.col("sample_archives_num").cast("string").alias("value")))).alias("kv")).select("kv.*")


def leaf_order_rows(orders: DataFrame) -> DataFrame:
    """(key = analysis_type, value = "[l0, l1, ...]") from leaf_order frames tagged by analysis_type.

    One row per analysis type; each list holds one entry per centroid (at most K).
    """
    return (orders.groupBy("analysis_type")
            .agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("_o"))
            .select(F.col("analysis_type").alias("key"),
                    F.concat(F.lit("["), F.array_join(F.transform("_o", lambda x: x["node"].cast("string")), ", "),
                             F.lit("]")).alias("value")))
