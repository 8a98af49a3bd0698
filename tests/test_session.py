import os

import pytest

from khata import session
from khata.session import balanced, drop_all, scratch, shared_dir, written


def plain(path):
    return "/" + path.removeprefix("file:").lstrip("/")


def test_written_tables_lie_in_the_shared_folder(spark, rows):
    df = written(spark.range(3), "test")
    assert rows(df) == [(0,), (1,), (2,)]
    assert plain(df.inputFiles()[0]).startswith(plain(shared_dir(spark)))
    assert written(spark.range(0), "none").count() == 0


def test_scratch_folders_are_deleted(spark):
    df = written(spark.range(3), "gone")
    folder = os.path.dirname(plain(df.inputFiles()[0]))
    place = scratch(spark, "never-written")
    assert os.path.isdir(folder) and not os.path.exists(plain(place))
    drop_all()
    assert not os.path.exists(folder) and not session._written


class OnCluster:
    """A session of a cluster without a shared folder, as far as shared_dir looks at it."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = self, {"spark.checkpoint.dir": folder} if folder else {}
        self.master = master

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(OnCluster(master))
    assert shared_dir(OnCluster(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_small_tables_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert balanced(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(10).repartition(cores)
    assert balanced(many) is many


def test_large_tables_are_not_spread(spark, monkeypatch):
    one = spark.range(10).coalesce(1)
    monkeypatch.setattr(session, "SPREAD_BYTES", 10)
    assert balanced(one) is one
