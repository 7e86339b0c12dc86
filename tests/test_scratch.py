from __future__ import annotations

from types import SimpleNamespace

import pytest

from tokenloom.sources.scratch import scratch_dir


def session(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session("spark://host:7077"))
    assert scratch_dir(session("spark://host:7077", "hdfs://x/tmp/")) == "hdfs://x/tmp"
    assert scratch_dir(session("local[2]")).startswith("file://")
