"""Where queries keep files that they make: the folder that a cluster shares, or /tmp for a local session."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOCAL = "/tmp/siftmail-files"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder (``spark.checkpoint.dir``); only a local session may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or LOCAL}/siftmail-{name}-{uuid.uuid4().hex}"
