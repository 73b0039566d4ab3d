import os

import pytest

from citeloom import session


class Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return Cluster.conf


def test_local_folder_is_refused_on_a_cluster(spark):
    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named.rstrip("/") if named else session.shared_dir(spark).startswith("file:")


def test_settled_tables_are_removed(spark):
    a, b = session.settle(spark.range(3), "a"), session.settle(spark.range(4), "b")
    at = [t._settled_at.removeprefix("file://") for t in (a, b)]
    assert a.count() == 3 and b.count() == 4
    session.forget(a, spark.range(1))
    assert [os.path.exists(p) for p in at] == [False, True] and b.count() == 4
    session.forget(a)
    session.forget_all(spark)
    assert not os.path.exists(at[1]) and not session._SETTLED
