import pytest

from corpusloom import runtime


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, configured=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session(master))
    assert runtime.shared_dir(Session(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert runtime.shared_dir(Session(master, None, "hdfs:///held")) == "hdfs:///held"


def test_a_local_master_has_a_folder_of_its_own():
    s = Session("local[8]")
    assert runtime.shared_dir(s) == runtime.shared_dir(s) == s.sparkContext.folder


def test_release(spark, tmp_path):
    import os

    t = runtime.table(spark.range(3))
    path = t._scratch_path.removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path) and t.count() == 3
    runtime.release(t)
    assert not os.path.isdir(path)
