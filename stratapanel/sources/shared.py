"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local master without that setting gets a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that outlive a query's plan: the checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()
