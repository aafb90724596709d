"""Sessions with the settings that the engine is designed for."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "quarry", master: str | None = None, **settings: str) -> SparkSession:
    """The active session, or a new one with SETTINGS and the given ones (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def serving(spark: SparkSession, partitions: int = 4) -> SparkSession:
    """A session of the same application for single, interactive queries.

    Planned once instead of stage by stage, over few partitions: for an index's hits on one
    query, not for batches or builds. Read the index with it.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", partitions)
    return own


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they find it by PYTHONPATH or the working folder."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT or getattr(context, "_quarry_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quarry-')}/quarry", "zip", ROOT, "quarry")
    context.addPyFile(archive)
    context._quarry_shipped = True
