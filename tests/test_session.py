import pytest

from setscope.session import ensure_checkpoint_dir, materialize


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master):
        self.master = master
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def getConf(self):
        return _Conf({})

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, conf):
        self.sparkContext = _Context(master)
        self.conf = _Conf(conf)


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn", {}))


def test_configured_checkpoint_dir_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs://shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://shared/ckpt"


def test_materialize_writes_under_the_checkpoint_dir(spark):
    root = ensure_checkpoint_dir(spark)
    df = materialize(spark.range(10), "unit")
    assert df.count() == 10
    files = df.inputFiles()
    assert files and all(root.replace("file:", "").rstrip("/") in f for f in files)


def test_release_tables_deletes_what_was_written(spark):
    """In a session of its own bookkeeping, so that tables of other tests stay."""
    import os

    from setscope import session

    before = list(session._WRITTEN)
    session._WRITTEN.clear()
    try:
        out = session.materialize(spark.range(3).toDF("id"), "gone")
        path = session._WRITTEN[0][2].removeprefix("file:")
        assert out.count() == 3 and os.path.isdir(path)
        assert session.release_tables(spark) == 1 and not os.path.exists(path) and not session._WRITTEN
    finally:
        session._WRITTEN.extend(before)
