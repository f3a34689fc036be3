import pytest

from allelio import session


class Context:
    applicationId = "app"

    def __init__(self, master, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint

    def getCheckpointDir(self):
        return self.checkpoint


class Session:
    def __init__(self, master, named=None, checkpoint=None):
        self.sparkContext = Context(master, checkpoint)
        self.conf = {} if named is None else {"spark.checkpoint.dir": named}


def test_the_sessions_folder_is_used(spark):
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/allelio/x-")
    assert session.shared_dir(Session("spark://host:1", named="s3://b/c/")) == "s3://b/c"
    assert session.shared_dir(Session("spark://host:1", checkpoint="s3://b/d")) == "s3://b/d"


def test_a_cluster_without_folder_is_refused_and_local_gets_its_own():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("spark://host:1"))
    assert session.shared_dir(Session("local[2]")) == session.shared_dir(Session("local[2]"))
