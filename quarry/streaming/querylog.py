"""An extension: the query log as a stream.

The batch engine's top queries and popular terms, kept up to date over windows
of event time while log files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.index import SCHEMAS


def read(spark: SparkSession, index_path: str, files_per_trigger: int = 100) -> DataFrame:
    """The query log as a stream of its files."""
    return spark.readStream.schema(SCHEMAS["query_log"]).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{index_path}/query_log")


def query_counts(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, query, n, no_hits by window of event time; rows later than ``late`` are dropped."""
    grouped = log.withWatermark("ts", late).groupBy(F.window("ts", window), "query")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") == 0).alias("no_hits")).select(F.col("window.start").alias("start"), "query", "n", "no_hits")


def write(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows as Parquet; runs over what is there, then stops."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
