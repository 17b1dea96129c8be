"""Scratch tables go below the session's checkpoint directory."""

import os

import pytest

from vitrine.session import checkpoint_root, clear_scratch, reliable_checkpoint, scratch_path


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class _Context:
    def __init__(self, conf, master="local[4]"):
        self._conf, self.dir, self.master = _Conf(conf), None, master

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, conf, master="local[4]"):
        self.sparkContext = _Context(conf, master)
        self.conf = _Conf()


def test_configured_checkpoint_dir_is_used():
    s = _Session({"spark.checkpoint.dir": "hdfs://cluster/shared/ckpt"})
    assert checkpoint_root(s) == "hdfs://cluster/shared/ckpt"
    assert s.sparkContext.dir == "hdfs://cluster/shared/ckpt"
    assert scratch_path(s, "t").startswith("hdfs://cluster/shared/ckpt/vitrine/t-")


def test_private_root_only_when_unset():
    s = _Session({})
    root = checkpoint_root(s)
    assert root and "vitrine-ckpt-" in root
    assert scratch_path(s, "x") != scratch_path(s, "x")


def test_clear_scratch_removes_what_a_query_wrote(spark):
    from vitrine import session
    before = len(session._SCRATCH)
    kept = reliable_checkpoint(spark.range(3), "kept")
    mark = len(session._SCRATCH)
    gone = reliable_checkpoint(spark.range(3), "gone").inputFiles()[0]
    assert clear_scratch(spark, mark) == before + 1
    assert kept.count() == 3 and not os.path.exists(gone.removeprefix("file://"))


def test_reliable_checkpoint_round_trip(spark):
    back = reliable_checkpoint(spark.range(5), "t")
    assert back.count() == 5
    assert checkpoint_root(spark) in back.inputFiles()[0]


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_cluster_without_checkpoint_dir_raises(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(_Session({}, master))
