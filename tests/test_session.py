import pytest

from peerpanel.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, values):
        self.master = master
        self._conf = _Conf(values)
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d

    def getConf(self):
        return self._conf


class _Session:
    def __init__(self, master, values=None):
        self.sparkContext = _Context(master, values or {})
        self.conf = _Conf(values or {})


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn"))


def test_cluster_setting_is_used_and_local_gets_scratch():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.dir == "hdfs:///shared/ckpt"
    local = _Session("local[4]")
    d = ensure_checkpoint_dir(local)
    assert d and local.sparkContext.dir == d
