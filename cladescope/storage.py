"""The folder that driver and executors share, for checkpoints and written tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where none is set and all runs on one machine a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            place = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()
