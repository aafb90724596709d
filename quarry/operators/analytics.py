"""Suggestions, query-log statistics, index statistics and relevance evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import kept_tokens, raw_tokens, with_stem
from quarry.operators.index import Index

LOG_ROWS, LOG_TERMS = 200, 200


def popular_terms(log: DataFrame, rows: int = LOG_ROWS, most: int = LOG_TERMS) -> DataFrame:
    """term, n: the most frequent stems of the latest ``rows`` queries (log: ts, query); ties by term."""
    latest = log.orderBy(F.col("ts").desc(), "query").limit(rows)
    tokens = with_stem(latest.select(F.explode(kept_tokens(F.col("query"))).alias("raw")))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(most)


def suggest(index: Index, prefix: str | None, k: int = 5) -> DataFrame:
    """word: the first k completions, by code point, among surface forms and popular query terms."""
    popular = popular_terms(index.query_log).join(index.terms.select("term", "surface"), "term", "left").select(F.coalesce("surface", "term").alias("word"))
    words = index.terms.where(F.col("surface") != "").select(F.lower("surface").alias("word")).union(popular)
    return words.where(F.col("word").startswith((prefix or "").lower())).distinct().orderBy("word").limit(max(k, 0))


def top_queries(log: DataFrame, k: int = 10) -> DataFrame:
    """query, n: the most frequent queries as typed; ties by query."""
    return log.groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "query").limit(k)


def index_stats(index: Index) -> DataFrame:
    """pages, avg_pagerank, vocabulary, in one row; an index without terms counts the distinct raw tokens of its bodies."""
    pages = index.docs.join(index.pagerank, "doc_id", "left").agg(F.count(F.lit(1)).alias("pages"), F.avg("pagerank").alias("avg_pagerank"))
    terms = index.terms.agg(F.count(F.lit(1)).alias("n"))
    if not index.terms.head(1):
        terms = index.docs.select(F.explode(raw_tokens(F.col("body"))).alias("t")).agg(F.count_distinct("t").alias("n"))
    # one row each
    return pages.crossJoin(terms.select(F.col("n").alias("vocabulary")))


def disk_bytes(spark, path: str) -> int:
    """Bytes under a path of any Hadoop store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(where).getLength() if system.exists(where) else 0


def relevance(hits: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """qid, p_at_k, rr for each judged query (hits: qid, url, rank; judged: qid, expected).

    A hit is relevant if its url holds one of the expected strings; precision
    divides by k however many hits there are.
    """
    marked = hits.where(F.col("rank") <= k).join(judged, "qid").select("qid", "rank", F.exists("expected", lambda e: F.contains("url", e)).alias("good"))
    told = marked.groupBy("qid").agg((F.count_if("good") / F.lit(float(k))).alias("p_at_k"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"))
    return judged.select("qid").join(told, "qid", "left").select("qid", F.coalesce("p_at_k", F.lit(0.0)).alias("p_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def link_degrees(links: DataFrame) -> DataFrame:
    """node, out_degree, in_degree over every link occurrence."""
    ends = links.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
