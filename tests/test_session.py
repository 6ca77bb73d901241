import pytest

from chatstream import session


def test_shuffles_follow_the_input_size(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffles(spark, 10**6) == spark.sparkContext.defaultParallelism
        assert session.size_shuffles(spark, 10**12) == 7451
        assert session.size_shuffles(spark, 10**14) == 745_059
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = session.shared_dir(spark, "x"), session.shared_dir(spark, "x")
    assert spark.sparkContext.applicationId in one and root in one and one != two
    assert one.rpartition("/")[0] == two.rpartition("/")[0]


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session(), "x")
