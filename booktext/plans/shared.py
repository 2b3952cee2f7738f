"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which is also made the session's checkpoint folder; a local master gets one of its own where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")
