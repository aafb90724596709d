"""A small web interface over an index. ``App.handle`` is free of sockets."""

from __future__ import annotations

import time
from collections.abc import Callable
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from quarry.operators import analytics
from quarry.operators import index as tables
from quarry.plans import search as plans
from quarry.session import serving
from quarry.sources.pages import log_query

HTML = {"Content-Type": "text/html; charset=utf-8"}
MOST, USUAL = 50, 10


def page(title: str, body: str, query: str = "") -> str:
    box = f'<form action="/search"><input name="q" value="{escape(query)}"><button>Search</button></form>'
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>{box}{body}</body></html>'


def marked(snippet: str) -> str:
    """Everything escaped but the marks."""
    return escape(snippet).replace("&lt;mark&gt;", "<mark>").replace("&lt;/mark&gt;", "</mark>")


def results(query: str, hits: list[dict], better: str | None, seconds: float) -> str:
    told = f"<p>{len(hits)} results in {seconds * 1000:.1f} ms</p>"
    if better:
        told += f'<p>Did you mean <a href="/search?q={escape(better)}">{escape(better)}</a>?</p>'
    items = "".join(f'<li><a href="{escape(h["url"])}">{escape(h["title"])}</a> <small>{h["score"]}</small><br>{marked(h["snippet"])}</li>' for h in hits)
    return page(query, told + (f"<ol>{items}</ol>" if hits else "<p>Nothing found.</p>"), query)


class App:
    """Routes /, /search and /stats over functions that tests can replace."""

    def __init__(self, find: Callable[[str, int], list[dict]] | None, better: Callable[[str], str | None], log: Callable[[str, int], None], stats: Callable[[], dict]):
        self.find, self.better, self.log, self.stats = find, better, log, stats

    def handle(self, path: str) -> tuple[int, dict, str]:
        parsed = urlsplit(path)
        route = parsed.path.rstrip("/") or "/"
        if route == "/":
            return 200, HTML, page("Search", f"<p>{self._figures().get('pages', 0)} pages indexed</p>")
        if route == "/search":
            asked = parse_qs(parsed.query)
            query = asked.get("q", [""])[0].strip()
            try:
                n = max(1, min(MOST, int(asked.get("n", [str(USUAL)])[0])))
            except ValueError:
                n = USUAL
            return 200, HTML, self._search(query, n)
        if route == "/stats":
            figures = self._figures()
            top = "".join(f"<tr><td>{escape(str(q))}</td><td>{n}</td></tr>" for q, n in figures.pop("top", []))
            rows = "".join(f"<tr><td>{escape(k)}</td><td>{v:.6f}</td></tr>" if isinstance(v, float) else f"<tr><td>{escape(k)}</td><td>{v}</td></tr>" for k, v in figures.items())
            return 200, HTML, page("Statistics", f"<table>{rows}</table><h2>Top queries</h2><table>{top}</table>")
        return 404, HTML, page("Not found", "<p>404: nothing here.</p>")

    def _figures(self) -> dict:
        try:
            return dict(self.stats())
        except Exception:  # noqa: BLE001  an index that isn't there yet has no figures
            return {}

    def _search(self, query: str, n: int) -> str:
        if not query:
            return page("Search", "<p>Type a query.</p>")
        if self.find is None:
            self.log(query, 0)
            return page(query, "<p>There is no index yet. Build one first.</p>", query)
        began = time.time()
        try:
            hits, better = self.find(query, n), self.better(query)
        except Exception:  # noqa: BLE001  a failed search shows no hits
            hits, better = [], None
        self.log(query, len(hits))
        return results(query, hits, better, time.time() - began)


def app_of(spark: SparkSession, path: str) -> App:
    """An app over the index at ``path``, whose tables are cached."""
    index = tables.read(serving(spark), path)
    for table in (index.docs, index.terms, index.postings, index.pagerank):
        table.cache()
    empty = not index.docs.head(1)

    def log(query: str, hits: int) -> None:
        try:
            log_query(spark, path, query, hits)
        except Exception:  # noqa: BLE001  a search must not fail for its log
            pass

    def stats() -> dict:
        row = analytics.index_stats(index).first()
        top = analytics.top_queries(tables.read(spark, path).query_log).collect()
        return {"pages": row.pages, "vocabulary": row.vocabulary, "avg_pagerank": float(row.avg_pagerank or 0), "bytes": analytics.disk_bytes(spark, path), "top": [(r.query, r.n) for r in top]}

    return App(None if empty else lambda q, n: plans.search(index, q, n), lambda q: plans.did_you_mean(index, q), log, stats)


def serve(spark: SparkSession, path: str, port: int) -> None:
    app = app_of(spark, path)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, headers, body = app.handle(self.path)
            data = body.encode()
            self.send_response(status)
            for k, v in {**headers, "Content-Length": str(len(data))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

    ThreadingHTTPServer(("", port), Handler).serve_forever()
