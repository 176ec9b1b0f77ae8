"""Shared-folder resolution without starting Spark (stand-in session objects)."""

from __future__ import annotations

import os

import pytest

from caudal.session import shared_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class _Ctx:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):  # noqa: N802 - Spark's name
        return self.ckpt

    def setCheckpointDir(self, d):  # noqa: N802
        self.ckpt = d


class _Session:
    def __init__(self, master, conf_value=None, ctx_dir=None):
        self.conf, self.sparkContext = _Conf(conf_value), _Ctx(master, ctx_dir)


def test_configured_folder_is_used_and_set_on_the_context():
    s = _Session("yarn", conf_value="hdfs://nn/shared/ckpt/")
    assert shared_dir(s) == "hdfs://nn/shared/ckpt"
    assert s.sparkContext.ckpt == "hdfs://nn/shared/ckpt/"


def test_local_session_without_folder_gets_a_private_one():
    s = _Session("local[4]")
    d = shared_dir(s)
    assert os.path.isdir(d) and s.sparkContext.ckpt == d


@pytest.mark.parametrize("master", ["spark://master:7077", "local-cluster[3,2,1024]", "yarn"])
def test_cluster_session_without_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        shared_dir(_Session(master))


def test_a_checkpoint_folder_of_the_callers_is_left_alone():
    s = _Session("yarn", conf_value="hdfs://nn/shared", ctx_dir="hdfs://nn/other")
    assert shared_dir(s) == "hdfs://nn/shared" and s.sparkContext.ckpt == "hdfs://nn/other"
