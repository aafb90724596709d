"""Sources and sinks of raw pages, manifests and crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRONTIER = "id string, outlinks array<string>, text string, title string, url string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, outlinks, title, url, ord from a JSON array; ord is the place in the array."""
    rows = "array<struct<id:string,outlinks:array<string>,title:string,url:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", rows).alias("rows"))
    return whole.select(F.posexplode("rows").alias("ord", "row")).select("row.*", "ord")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """id (file name without its ending), html: one row per file."""
    files = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html$", 1).alias("id"), F.col("value").alias("html"))


def read_site(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """id, url, title, ord, html, present: the manifest's pages with their files; present is false where the file is missing."""
    files = read_pages(spark, folder).withColumn("present", F.lit(True))
    rows = read_manifest(spark, manifest).select("id", "url", "title", "ord").join(files, "id", "left")
    return rows.withColumn("present", F.coalesce("present", F.lit(False)))


def write_frontier(pages: DataFrame, path: str) -> None:
    """One JSON object a line, in the order of fetch_ord across files and within them."""
    pages.repartitionByRange("fetch_ord").sortWithinPartitions("fetch_ord").select("id", "outlinks", "text", "title", "url", "fetch_ord").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages; blank lines are skipped. Without fetch_ord in the file, page numbers stand in for it."""
    rows = spark.read.schema(FRONTIER + ", fetch_ord long").json(path)
    return rows.withColumn("fetch_ord", F.coalesce("fetch_ord", F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long")))


def log_query(spark: SparkSession, index_path: str, query: str, hits: int) -> None:
    """Appends a row to the query log."""
    spark.range(1).select(F.current_timestamp().alias("ts"), F.lit(query).alias("query"), F.lit(hits).cast("int").alias("hits")).coalesce(1).write.mode("append").parquet(f"{index_path}/query_log")
