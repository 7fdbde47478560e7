"""The shared folder."""

from types import SimpleNamespace

import pytest

from wavequarry.session import shared_dir


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key: folder if key == "spark.checkpoint.dir" else None)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: conf))


def test_shared_folder_is_set_or_local():
    assert shared_dir(session("yarn", "s3a://bucket/x/")) == "s3a://bucket/x/app-1"
    assert shared_dir(session("local[8]")) == shared_dir(session("local")) == "/tmp/checkpoints/app-1"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
