"""The inverted index: building it, and reading and writing its tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html
from quarry.functions.text import kept_tokens, with_stem

SCHEMAS = {
    "docs": "doc_id long, url string, title string, body string, body_len int, title_len int",
    "links": "src long, dst long",
    "terms": "term string, df long, surface string",
    "postings": "term string, doc_id long, field string, tf int, len int, positions array<int>",
    "pagerank": "doc_id long, pagerank double",
    "query_log": "ts timestamp, query string, hits int",
}


@dataclass
class Index:
    """The tables of an index; ``pagerank`` and ``query_log`` may be empty."""

    docs: DataFrame
    links: DataFrame
    terms: DataFrame
    postings: DataFrame
    pagerank: DataFrame
    query_log: DataFrame

    def stats(self) -> tuple[int, float, float]:
        """Documents, mean body length, mean title length."""
        if not hasattr(self, "_stats"):
            row = self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("body_len").alias("body"), F.avg("title_len").alias("title")).first()
            self._stats = (row.n, row.body or 0.0, row.title or 0.0)
        return self._stats


def docs_of(pages: DataFrame) -> DataFrame:
    """doc_id, url, title, body from frontier pages (id, url, title, text)."""
    return pages.select(html.page_number(F.col("id")).alias("doc_id"), "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, field, raw, term, pos, len: kept tokens with their stems; positions count kept tokens, each field from 0 to its length."""
    both = F.array(*(F.struct(F.lit(f).alias("field"), kept_tokens(F.col(f)).alias("tokens")) for f in ("title", "body")))
    rows = docs.select("doc_id", F.inline(both)).select("doc_id", "field", F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "raw"))
    return with_stem(rows).select("doc_id", "field", "raw", "term", "pos", "len")


def postings_of(tokens: DataFrame) -> DataFrame:
    """term, doc_id, field, tf, len (tokens of the field), positions (ascending)."""
    grouped = tokens.groupBy("term", "doc_id", "field").agg(F.max("len").alias("len"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", "doc_id", "field", F.size("positions").alias("tf"), "len", "positions")


def terms_of(tokens: DataFrame) -> DataFrame:
    """term, df (documents that hold it in either field), surface.

    The surface is the most frequent raw form, of equally frequent ones the
    first by document, title before body, position.
    """
    first = F.struct("doc_id", F.when(F.col("field") == "title", 0).otherwise(1).alias("rank"), "pos")
    forms = tokens.groupBy("term", "raw").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    surfaces = forms.groupBy("term").agg(F.min_by("raw", F.struct(-F.col("n"), "first")).alias("surface"))
    df = tokens.select("term", "doc_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(surfaces, "term").select("term", "df", "surface")


def with_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "url", "title", "body", F.size(kept_tokens(F.col("body"))).alias("body_len"), F.size(kept_tokens(F.col("title"))).alias("title_len"))


def links_of(pages: DataFrame) -> DataFrame:
    """src, dst of every link occurrence between known pages (id, outlinks)."""
    rows = pages.select("id", F.explode("outlinks").alias("target"))
    known = pages.select(F.col("id").alias("target"))
    return rows.join(known, "target", "left_semi").select(html.page_number(F.col("id")).alias("src"), html.page_number(F.col("target")).alias("dst"))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def check_unique(docs: DataFrame) -> None:
    """Raises where an id or url occurs twice."""
    for column in ("doc_id", "url"):
        twice = docs.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").select(column).head(1)
        if twice:
            raise ValueError(f"{column} {twice[0][0]!r} occurs more than once")


def build(docs: DataFrame, links: DataFrame | None = None) -> Index:
    """An index of docs (doc_id, url, title, body), lazily."""
    spark = docs.sparkSession
    tokens = tokens_of(docs)
    return Index(with_lengths(docs), links if links is not None else empty(spark, "links"), terms_of(tokens), postings_of(tokens), empty(spark, "pagerank"), empty(spark, "query_log"))


#: The file that names the folder of the version that readers see.
POINTER = "CURRENT"


def _store(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str:
    """The folder of the index's published version; ``path`` itself if none is published."""
    where, system = _store(spark, f"{path}/{POINTER}")
    if not system.exists(where):
        return path
    stream = system.open(where)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes ``version`` the one that readers see, by one rename; deletes those before the last one."""
    before = current(spark, path)
    draft, system = _store(spark, f"{path}/{POINTER}.{version}")
    stream = system.create(draft, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    final, _ = _store(spark, f"{path}/{POINTER}")
    hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(draft), system.makeQualified(final), overwrite)
    for found in system.listStatus(_store(spark, path)[0]):
        name = found.getPath().getName()
        if name.startswith("version-") and name not in (version, before.rpartition("/")[2]):
            system.delete(found.getPath(), True)


def write(index: Index, path: str, partitions: int | None = None) -> None:
    """Writes the index's tables as a new version and then publishes it at ``path``; the query log there stays.

    A write that fails leaves what readers see as it was. The version before stays for
    those that read it still. Postings are range-partitioned and sorted by term, so a
    reader's filter on terms skips row groups by their statistics.
    """
    check_unique(index.docs)
    version = f"version-{uuid.uuid4().hex}"
    postings = index.postings.repartitionByRange(partitions, "term") if partitions else index.postings.repartitionByRange("term")
    postings = postings.sortWithinPartitions("term", "doc_id")
    for table, df in (("docs", index.docs), ("links", index.links), ("terms", index.terms), ("postings", postings), ("pagerank", index.pagerank)):
        df.write.parquet(f"{path}/{version}/{table}")
    _publish(index.docs.sparkSession, path, version)


def write_pagerank(ranks: DataFrame, path: str) -> None:
    """Replaces the ranks (doc_id, pagerank) of the published version."""
    ranks.write.mode("overwrite").parquet(f"{current(ranks.sparkSession, path)}/pagerank")


def read(spark: SparkSession, path: str) -> Index:
    """The published index at ``path``; tables that aren't there are empty."""
    folder = current(spark, path)
    return Index(**{f.name: _table(spark, path if f.name == "query_log" else folder, f.name) for f in fields(Index)})


def _table(spark: SparkSession, path: str, table: str) -> DataFrame:
    where, system = _store(spark, f"{path}/{table}")
    if not system.exists(where):
        return empty(spark, table)
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")


def counts(index: Index) -> dict[str, int]:
    return {"docs": index.docs.count(), "links": index.links.count(), "terms": index.terms.count()}
