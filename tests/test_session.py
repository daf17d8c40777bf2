import pytest

from linkgrid import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})()


def test_the_clusters_folder_is_used(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = session.shared_dir(spark, "x"), session.shared_dir(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)


def test_unset_folder():
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Fake("yarn"), "x")
    assert session.shared_dir(Fake("local[2]"), "x").startswith("/tmp/spark-")


def test_time_zone_is_pinned(spark):
    assert session.use_utc(spark).conf.get("spark.sql.session.timeZone") == "UTC"
