"""Where work tables go."""

from __future__ import annotations

import pytest

from glossa.session import FileSystem, WorkFolder, shared_dir


class Unset:
    """A session whose cluster names no folder."""

    def __init__(self, spark, master):
        self.conf = type("Conf", (), {"get": lambda self, key, default=None: default})()
        self.sparkContext = type(
            "Context",
            (),
            {
                "master": master,
                "dir": None,
                "getCheckpointDir": lambda self: self.dir,
                "setCheckpointDir": lambda self, d: setattr(self, "dir", d),
            },
        )()


def test_the_clusters_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
        assert WorkFolder(spark).root.startswith(named)


def test_own_folder_only_where_none_is_named(spark):
    session = Unset(spark, "local[4]")
    assert shared_dir(session) == shared_dir(session) != ""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Unset(spark, "spark://host:7077"))


def test_work_folders_are_apart_and_can_be_dropped(spark, folder):
    a, b = WorkFolder(spark, folder), WorkFolder(spark, folder)
    kept = b.write(spark.range(3), "t")
    assert a.write(spark.range(5), "t").count() == 5 and kept.count() == 3
    a.drop()
    assert not FileSystem(spark, folder).exists(a.root) and kept.count() == 3


def test_slices(spark, folder):
    df = spark.range(10).selectExpr("id", "id % 3 as s")
    parts = WorkFolder(spark, folder).write_slices(df, "t", "s")
    assert sorted(p.count() for p in parts) == [3, 3, 4] and parts[0].columns == ["id"]
