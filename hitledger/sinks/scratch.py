"""Where intermediate tables go: the shared folder the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path for one table. Only a local session may fall back to a folder of its machine."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hitledger-")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
