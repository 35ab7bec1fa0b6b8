import pytest

from cohortwise import session


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class Fake:
    def __init__(self, value, master):
        self.conf = Conf(value)
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})()


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(Fake("hdfs:///shared", "yarn")) == "hdfs:///shared"


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake(None, "yarn"))


def test_local_session_gets_one_folder():
    assert session.shared_dir(Fake(None, "local[2]")) == session.shared_dir(Fake(None, "local[2]"))


def test_written_rows_keep_their_types(spark):
    df = spark.createDataFrame([(1, None, [0.5])], "a int, b string, c array<double>")
    again = session.materialize(df, "test")
    assert again.dtypes == df.dtypes and again.first() == df.first()
