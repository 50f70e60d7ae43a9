"""What operators write to be read again by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the driver and all executors share: the session's, or the one in ``spark.checkpoint.dir``; where neither is set and Spark runs in this process alone, a new temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = os.path.join(tempfile.gettempdir(), f"folioscope-{uuid.uuid4().hex}")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, without its lineage: it is computed once, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
