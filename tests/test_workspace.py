import os
from pathlib import Path
from urllib.parse import urlparse

import pytest

from foliospark import workspace


def test_tables_live_in_the_shared_folder(spark):
    before = list(workspace._written)
    df = workspace.materialize(spark.range(5).toDF("a"), "t")
    path = workspace._written[-1]
    assert path.startswith(workspace.shared_dir(spark)) and df.count() == 5 and df.columns == ["a"]
    workspace._written[:] = [path]
    workspace.clear(spark)
    workspace._written[:] = before
    assert not os.path.exists(urlparse(path).path)


def test_empty_tables_keep_their_schema(spark):
    df = workspace.materialize(spark.createDataFrame([], "a int, b array<string>"), "t")
    assert df.count() == 0 and df.dtypes == [("a", "int"), ("b", "array<string>")]


def test_scratch_tables_go(spark, tmp_path):
    before = len(workspace._written)
    with workspace.scratch(spark):
        df = workspace.materialize(spark.range(3), "gone")
        assert df.count() == 3
        path = workspace._written[-1]
    assert len(workspace._written) == before and not Path(path.removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session())
