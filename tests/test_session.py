"""The shared folder."""

import os

import pytest

from lodestone import session
from lodestone.session import shared_dir


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def __init__(self, master, folder):
            self.values = {"spark.master": master, "spark.checkpoint.dir": folder}

        def get(self, key, default=None):
            return self.values.get(key) or default

        def set(self, key, value):
            self.values[key] = value

    class Session:
        def __init__(self, master, folder=None):
            self.conf = Conf(master, folder)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))
        assert shared_dir(Session(master, "hdfs://x/work/")) == "hdfs://x/work"
    assert shared_dir(Session("local[4]")).startswith("file://")


def test_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    assert session.materialize(spark.range(3), "x").count() == 3 and os.listdir(f"{tmp_path}/tables")
    session.clear_tables(spark)
    assert not os.path.exists(f"{tmp_path}/tables")
