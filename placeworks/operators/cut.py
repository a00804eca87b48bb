"""Cutting the lineage of iterations."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir; where that is unset, in a folder of this machine, which only a local master can use."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp())
    return df.checkpoint()
