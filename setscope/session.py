"""Session helpers: a tuned local session for tests and a checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: (application, owner, folder) given out by ``scratch_folder``.
_WRITTEN: list[tuple[str, str, str]] = []
_OWNER: ContextVar[str] = ContextVar("setscope_owner", default="")


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """A local session with AQE on and the UI off (tests, bench, entry)."""
    builder = (SparkSession.builder.master(f"local[{cores}]")
               .appName("setscope")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for key, value in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only where none is configured.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; only a local master may fall back to a fresh
    temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="setscope-ckpt-"))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the checkpoint folder; ``release_tables`` deletes it."""
    path = f"{ensure_checkpoint_dir(spark)}/setscope-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark.sparkContext.applicationId, _OWNER.get(), path))
    return path


@contextmanager
def tables_of(owner: str):
    """Scratch folders given out inside belong to ``owner``, who can release them without touching others'."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def materialize(df, tag: str = "state", partition_by: str | None = None):
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan once (a
    checkpoint of an un-cached frame runs it twice). The folder is the
    shared ``spark.checkpoint.dir``; each call uses a fresh sub-folder, which
    stays until ``release_tables``.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, tag)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    # with its schema given, an empty partitioned table reads too, and no file is opened to find it
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession, owner: str | None = None) -> int:
    """Delete the scratch folders of ``owner`` (None: of the whole application); returns how many.

    Frames that still read one of them fail afterwards, so it is called when
    the owner's results are written.
    """
    own = [entry for entry in _WRITTEN
           if entry[0] == spark.sparkContext.applicationId and owner in (None, entry[1])]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for entry in own:
        folder = hadoop.Path(entry[2])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _WRITTEN.remove(entry)
    return len(own)
