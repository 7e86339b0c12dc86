"""The folder for tables that a query writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dirs: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a session without that setting (tests on one machine) gets a folder of
    its own, removed when the process ends. On a cluster that would be a folder of
    each machine, so there the setting is wanted.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="tokenloom-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return f"file://{_own_dirs[0]}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/tokenloom/{tag}-{uuid.uuid4().hex}"
