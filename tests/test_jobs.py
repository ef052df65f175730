import uuid
from dataclasses import replace

from conftest import SF_SMALL
from setscope.options import Options
from setscope.plans.jobs import EXPLORE_TASKS, RESULT_TASKS, Job
from setscope.session import ensure_checkpoint_dir, materialize
from setscope.sources import bindings as B
from setscope.sources.results import read_result


def test_whole_job_writes_every_dataset(spark):
    out = f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    m, reg = B.order_nation(spark, SF_SMALL)
    opts = replace(Options(), k_low=3, k_high=4, t_low=3, t_high=4, big_k=8, opt_k_raw=3, opt_k_pca=4,
                   opt_t_raw=3, opt_t_pca=4, min_support=0.005, min_confidence=0.05)
    job = Job(spark, m, reg, out, opts)
    job.run(EXPLORE_TASKS + RESULT_TASKS)
    info = {r.key: r.value for r in job.save_info("b1", "nation").collect()}
    job.release()
    for name in ("frequencies", "confidences", "predictions", "top_pcs", "pc_explained_variance", "elbow",
                 "silhouette", "distance_matrix", "dendrogram_merges",
                 "dendrogram_leaf_order", "archives_frequencies", "archives_occurrences", "trend_vector"):
        assert read_result(spark, f"{out}/{name}").count() > 0, name
    assert {"K", "sample_count", "raw", "pca"} <= set(info)
    assert info["sample_data_table"] == "1.0" and info["db_name"] == ""
    assert len(read_result(spark, f"{out}/trend_vector").select("model_type", "analysis_type").distinct().collect()) == 6
    tags = {tuple(r) for r in read_result(spark, f"{out}/distance_matrix").select("model_type", "analysis_type")
            .distinct().collect()}
    assert tags == {(m, a) for m in ("kmeans", "hierarchical") for a in ("raw", "pca")}


def test_recorded_sample_is_the_applied_one(spark):
    m, reg = B.order_nation(spark, SF_SMALL)
    job = Job(spark, m, reg, f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}", sample=0.25)
    assert 0.15 * m.count() < job.members.count() < 0.35 * m.count()
    info = {r.key: r.value for r in job.save_info("db.members", "db.nation").collect()}
    assert info["sample_data_table"] == "0.25" and info["db_name"] == "db"


def test_a_released_job_leaves_other_tables_alone(spark):
    m, reg = B.order_nation(spark, SF_SMALL)
    opts = replace(Options(), k_low=2, k_high=3, big_k=4, t_low=2, t_high=3)
    one, two = (Job(spark, m, reg, f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}", opts) for _ in range(2))
    one.run(["silhouette"])
    two.run(["silhouette"])
    kept = materialize(m.limit(3), "other")
    one.release()
    assert kept.count() == 3
    two.run(["distance_matrix"])
    assert read_result(spark, f"{two.out}/distance_matrix").count() > 0
    two.release()
