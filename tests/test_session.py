from types import SimpleNamespace

import pytest

from weft.session import checkpoint_dir


def session(master, known=None, named=None):
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named}, getCheckpointDir=lambda: made[-1] if made else known, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))


def test_a_cluster_must_name_its_checkpoint_folder():
    with pytest.raises(RuntimeError):
        checkpoint_dir(session("spark://host:7077"))
    assert checkpoint_dir(session("spark://host:7077", named="/shared")) == "/shared"
    assert checkpoint_dir(session("yarn", known="/set/before")) == "/set/before"
    assert "weft-checkpoint-" in checkpoint_dir(session("local[4]"))
