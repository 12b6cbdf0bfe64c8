import pytest

from cutover import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    """Just enough of a session to ask where intermediate tables go."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("C", (), {"master": master, "applicationId": "a", "getConf": lambda _: self.conf})()


def test_the_cluster_names_the_folder():
    assert session.shared_folder(Fake("yarn", **{session.CHECKPOINT_KEY: "s3a://b/ckpt/"})) == "s3a://b/ckpt"
    with pytest.raises(RuntimeError):
        session.shared_folder(Fake("yarn"))
    local = session.shared_folder(Fake("local[2]"))
    assert local and session.shared_folder(Fake("local[2]")) == local


def test_stage_keeps_values(spark):
    from pyspark.sql import functions as F

    df = session.stage(spark.range(100).withColumn("r", F.rand()), "t")
    assert df.collect() == df.collect() and df.count() == 100


def test_staged_tables_go_with_their_block(spark):
    import pathlib

    with session.staged(spark) as outer:
        with session.staged(spark) as inner:
            assert session.stage(spark.range(5), "t").count() == 5 and len(inner) == 1
        assert not pathlib.Path(inner[0]).exists()
        kept = session.stage(spark.range(3), "t")
        assert kept.count() == 3 and outer != inner and len(outer) == 1
    assert not pathlib.Path(outer[0]).exists()
