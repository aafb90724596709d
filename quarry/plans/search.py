"""Searching an index: batches, single queries, evaluation; and building one from a corpus."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html
from quarry.operators import analytics, crawl, pagerank, spelling
from quarry.operators import index as tables
from quarry.operators.ranking import Batch
from quarry.operators.snippets import snippet
from quarry.sources import corpus

#: Queries with strings of which a relevant hit's url holds one, for the generated corpus.
JUDGED = [
    ("mainsail halyard", ["/sailing/"]),
    ('"storm jib"', ["/sailing/"]),
    ("queen brood", ["/beekeeping/"]),
    ('"varroa mite treatment"', ["/beekeeping/"]),
    ("gambit fianchetto", ["/chess/"]),
    ("kiln porcelain", ["/pottery/"]),
    ('"ash glaze"', ["/pottery/"]),
    ("magma strata -yarn", ["/geology/"]),
    ("cardigan ribbing OR purl sleeve", ["/knitting/"]),
    ("prompter monologue", ["/theatre/"]),
    ("viaduct locomotive", ["/railways/"]),
    ("gauge site:railways", ["/railways/"]),
    ("heron plumage", ["/birding/"]),
    ("ligature kerning", ["/typography/"]),
]


def search_batch(index: tables.Index, queries: dict[int, str], n: int = 10) -> DataFrame:
    """qid, rank, id, url, title, snippet, score (4 decimals) of the best n hits of each query."""
    asked = {qid: q for qid, q in queries.items() if (q or "").strip()}
    batch = Batch(index, asked)
    hits = batch.ranked(n)
    texts = index.docs.select("doc_id", "url", "title", "body")
    # the hits are few: n for each query
    few = F.broadcast(hits) if n * len(asked) <= 10_000 else hits
    shown = texts.join(few, "doc_id").join(batch.asked.select("qid", "marks"), "qid")
    return shown.select("qid", "rank", html.page_name(F.col("doc_id")).alias("id"), "url", "title", snippet(F.col("body"), F.col("marks")).alias("snippet"), F.bround("score", 4).alias("score"))


def search(index: tables.Index, query: str | None, n: int = 10) -> list[dict]:
    """The hits of one query as dicts, best first; empty for a blank query."""
    if not (query or "").strip():
        return []
    # n rows: sorting them here saves a shuffle
    rows = sorted(search_batch(index, {0: query}, n).collect(), key=lambda r: r["rank"])
    return [{k: r[k] for k in ("id", "url", "title", "snippet", "score")} for r in rows]


def did_you_mean(index: tables.Index, query: str | None) -> str | None:
    return spelling.did_you_mean(index, {0: query})[0] if (query or "").strip() else None


def evaluate(index: tables.Index, judged: list[tuple[str, list[str]]] = JUDGED, k: int = 5) -> DataFrame:
    """qid, p_at_k, rr of all judged queries, run as one batch."""
    hits = search_batch(index, {i: q for i, (q, _) in enumerate(judged)}, k)
    expected = index.docs.sparkSession.createDataFrame([(i, e) for i, (_, e) in enumerate(judged)], "qid long, expected array<string>")
    return analytics.relevance(hits.select("qid", "url", "rank"), expected, k)


def run_eval(index: tables.Index) -> dict:
    row = evaluate(index).agg(F.avg("p_at_k").alias("p"), F.avg("rr").alias("r"), F.count(F.lit(1)).alias("n")).first()
    return {"p_at_5": row.p or 0.0, "mrr": row.r or 0.0, "n": row.n if index.docs.head(1) else 0}


def crawled(pages: DataFrame, **how) -> tuple[DataFrame, dict]:
    """Frontier pages (id, url, title, text, outlinks, fetch_ord) from pages (id, url, html, ord, and present if pages may be missing)."""
    kept = ["present"] if "present" in pages.columns else []
    manifest = pages.select("id", "url", "ord", html.outlinks_of(F.col("html")).alias("outlinks"), *kept)
    order, figures = crawl.crawl(manifest, **how)
    fetched = order.join(pages.select("id", "url", "html"), "id")
    return fetched.select("id", "url", html.title_of(F.col("html")).alias("title"), html.text_of(F.col("html")).alias("text"), "outlinks", "fetch_ord"), figures


def build(spark: SparkSession, path: str, seed: int = 7, n: int = 2500, say: Callable[[str], None] = print) -> dict[str, float]:
    """Corpus, crawl, index and PageRank under ``path``; seconds of each stage. A failed stage is reported, and the rest goes on."""
    took: dict[str, float] = {}

    def stage(name: str, work: Callable[[], object]) -> None:
        began = time.time()
        try:
            told = work()
            took[name] = time.time() - began
            say(f"{name}: {told} in {took[name]:.1f} s")
        except Exception as e:  # noqa: BLE001
            say(f"{name} failed: {type(e).__name__}: {e}")

    def do_crawl() -> dict:
        rows, figures = crawled(spark.read.parquet(f"{path}/corpus"))
        rows.write.mode("overwrite").parquet(f"{path}/frontier")
        return figures

    def do_index() -> dict:
        pages = spark.read.parquet(f"{path}/frontier")
        made = tables.build(tables.docs_of(pages), tables.links_of(pages))
        tables.write(made, f"{path}/index")
        return tables.counts(tables.read(spark, f"{path}/index"))

    def do_rank() -> int:
        made = tables.read(spark, f"{path}/index")
        tables.write_pagerank(pagerank.compute(made.docs, made.links), f"{path}/index")
        return made.docs.count()

    stage("corpus", lambda: corpus.generate(spark, f"{path}/corpus", seed, n))
    stage("crawl", do_crawl)
    stage("index", do_index)
    stage("pagerank", do_rank)
    return took
