import os

import pytest

from lithoflow.plans import lineage


class Session:
    """A session of some master that names no folder."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf = self
        self.master = master
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d

    def get(self, key, default):
        return default


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,512]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        lineage.checkpoint_dir(Session(master))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_machine_takes_its_own(master):
    assert os.path.isdir(lineage.checkpoint_dir(Session(master)))


def test_cut_and_clear(spark):
    df = lineage.cut(spark.range(5))
    assert df.count() == 5
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert os.listdir(root)
    lineage.clear(spark)
    assert os.path.isdir(root) and not os.listdir(root)
    assert lineage.cut(spark.range(3)).count() == 3
