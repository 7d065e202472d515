"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the session names; where it names none one is set in the warehouse, which executors
    see too. Only a local session, whose executors are this machine, gets a temporary one."""
    if not spark.sparkContext.getCheckpointDir():
        local = spark.sparkContext.master.split("[")[0] == "local"
        own = tempfile.mkdtemp(prefix="arborscale-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/arborscale-scratch"
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/arborscale-{name}-{uuid.uuid4().hex}"
