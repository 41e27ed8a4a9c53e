"""Where jobs keep tables that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_root: tempfile.TemporaryDirectory | None = None


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder.

    It is read from ``spark.checkpoint.dir``. Where that is unset, a ``local`` master gets a
    temporary folder that goes away with the process; any other master is refused, because a folder of
    one machine is not visible to the executors of another.
    """
    global _local_root
    configured = spark.conf.get(_CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.TemporaryDirectory(prefix="pairwright-", ignore_cleanup_errors=True)
    return _local_root.name


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/pairwright/{label}-{uuid.uuid4().hex}"
