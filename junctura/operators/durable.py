"""Cutting lineage so that a lost executor costs only its own tasks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster names in spark.checkpoint.dir and read from there.

    Where none is named and Spark runs in one process (tests on one machine) a new local folder is taken; on a cluster one must be named.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
            folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
