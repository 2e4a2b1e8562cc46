"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``, or its checkpoint folder.

    Where it names none, a temporary folder becomes its checkpoint folder, but only if all tasks
    run on this machine; on a cluster every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="provenor-")
    context.setCheckpointDir(root)
    return root
