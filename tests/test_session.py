import os

import pytest

from archivolt import session


def test_release_removes_a_checkpoint(spark):
    rows = session.cut(spark.range(100))
    kept = session.cut(rows.selectExpr("id * 2 AS id"))
    file = rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(file)
    session.release(rows)
    assert not os.path.isdir(file) and kept.count() == 100
    session.release(kept.filter("id > 3"))  # no checkpoint of its own
    assert kept.count() == 100


def test_small_tables(spark):
    assert session.is_small(spark.range(5), 5) and not session.is_small(spark.range(6), 5)


def test_a_cluster_must_name_its_checkpoint_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Scala:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Scala

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session)
