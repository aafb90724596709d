"""Helpers that several operators use: shared storage, lineage cuts, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trim() -> None:
    """Gives a Python worker's freed memory back to the system, between batches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests in one process) a temporary folder
    is used instead, and remembered as the session's checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget_on_exit(spark: SparkSession, path: str) -> None:
    """Has the store delete a path in the shared folder when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there,
    so a lost executor costs a re-read and never a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    forget_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    ``edges`` has the columns u and v of one orderable type. Alternating large
    and small stars need a number of rounds that grows with the logarithm of
    the nodes. Each round writes the minima of nodes before it joins them back: with
    tables on both sides Spark can split the join of a node that has very many
    neighbours. Self-loops and repeated edges are harmless; nodes without an edge to
    another node don't appear.
    """

    def sign(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return row[0], row[1]

    current = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = sign(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        moved = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(moved).alias("e")).select("e.*").where("u <> v").distinct()
        current = written(small, "edges")
        after = sign(current)
        if after == before:
            break
        before = after
    reached = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return reached.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
