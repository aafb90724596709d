"""Tables that cut lineage, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder: ``spark.checkpoint.dir``, or in one process a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quarry-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder."""
    ready(df.sparkSession)
    return df.checkpoint()
