"""The engine's queries over the standard tables, and the same in SQL.

Documents get a title (what stands before the first end of a sentence or line), a url (by
language and id) and, for blending, a rank that their id gives. Links are those
of customers to their suppliers, and arithmetic ones between pages. Conversations of users
serve as a query log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html, text
from quarry.operators import analytics, crawl, pagerank, ranking, spelling
from quarry.operators import index as tables
from quarry.operators.snippets import LEAD, LENGTH
from quarry.plans import search

HOST = html.HOST
#: The batch that the retrieval queries run.
SEARCHES = {
    1: "license",
    2: '"general public license"',
    3: "licensed apache OR released mit",
    4: "license -apache",
    5: "license site:en",
    6: '"the MIT License" OR "the Apache License" -"version 3"',
    7: "tion und OR que les site:de",
    8: "license license released",
    9: "the",
    10: "-license",
}
WEB_SEARCHES = {11: "track OR license", 12: "und der site:de"}
MISSPELT = ["licens", "lisence", "publc", "releasd", "apach", "versoin", "generl", "zzzzzzzz", "the", "x"]
PAGERANK_ROUNDS = 20
TITLE = r"^[^.!?\n]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(f"{HOST}/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.regexp_extract(body, TITLE, 0).alias("title"),
        body.alias("body"),
    )


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 37 % 101 + 1) / 1000.0).alias("pagerank"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("text").alias("query"))


def index(spark: SparkSession, sf_dir: str) -> tables.Index:
    made = tables.build(docs(spark, sf_dir))
    made.pagerank, made.query_log = ranks(spark, sf_dir), log(spark, sf_dir)
    return made


def six(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


# --- text and index ----------------------------------------------------------------------------


def tokens(spark, d):
    return tables.tokens_of(docs(spark, d)).drop("len")


def stems(spark, d):
    rows = docs(spark, d).select(F.explode(text.raw_tokens(F.col("body"))).alias("raw")).distinct()
    return text.with_stem(rows)


def stopword_filter(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.raw_tokens(F.col("body"))).cast("long").alias("n_raw"), F.size(text.kept_tokens(F.col("body"))).cast("long").alias("n_kept"))


def postings(spark, d):
    return index(spark, d).postings.select("term", "doc_id", "field", F.col("tf").cast("long").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def term_df(spark, d):
    return index(spark, d).terms.select("term", "df")


def surface_forms(spark, d):
    return index(spark, d).terms.select("term", "surface")


def doc_lengths(spark, d):
    return index(spark, d).docs.select("doc_id", F.col("body_len").cast("long").alias("body_len"), F.col("title_len").cast("long").alias("title_len"))


def corpus_stats(spark, d):
    return index(spark, d).docs.agg(F.count(F.lit(1)).alias("n_docs"), six(F.avg("body_len")).alias("avg_body"), six(F.avg("title_len")).alias("avg_title"))


# --- retrieval and ranking -----------------------------------------------------------------------


def _batch(spark, d, *ids):
    return ranking.Batch(index(spark, d), {i: SEARCHES[i] for i in ids or SEARCHES})


def _candidates(*ids):
    def run(spark, d):
        return _batch(spark, d, *ids).scores().select("qid", "doc_id")

    return run


def idf(spark, d):
    ix = index(spark, d)
    return ix.terms.select("term", six(ranking.idf(ix.stats()[0], F.col("df"))).alias("idf"))


def _bm25_of(field):
    def run(spark, d):
        ix = index(spark, d)
        n, body, title = ix.stats()
        rows = ix.postings.where(F.col("field") == field).join(ix.terms, "term")
        score = ranking.idf(n, F.col("df")) * ranking.bm25(F.col("tf"), F.col("len"), body if field == "body" else title)
        return rows.select("term", "doc_id", six(score * (ranking.TITLE_WEIGHT if field == "title" else 1.0)).alias("score"))

    return run


def bm25_scores(spark, d):
    return _batch(spark, d).scores().select("qid", "doc_id", six("bm25").alias("bm25"))


def blend(spark, d):
    b = _batch(spark, d)
    return b.blended(b.scores()).select("qid", "doc_id", six("score").alias("score"))


def search_topn(spark, d):
    return _batch(spark, d, 1).ranked(10).select("qid", "doc_id", six("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def search_batch(spark, d):
    return _batch(spark, d).ranked(10).select("qid", "doc_id", six("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def snippets(spark, d):
    return search.search_batch(index(spark, d), {1: SEARCHES[1], 2: SEARCHES[2], 3: SEARCHES[3]}, 5).select("qid", F.col("rank").cast("long").alias("rank"), "id", "url", "title", "snippet")


def search_hits(spark, d):
    """What a user sees of the hits: names and scores of four decimals."""
    return search.search_batch(index(spark, d), SEARCHES).select("qid", F.col("rank").cast("long").alias("rank"), "id", "score")


def query_parse(spark, d):
    """The parser's relation; a literal table, as parsing happens on the driver."""
    return ranking.Batch(index(spark, d), SEARCHES).parsed.select("qid", F.col("grp").cast("long").alias("grp"), F.col("clause").cast("long").alias("clause"), "phrase", "neg", F.col("place").cast("long").alias("place"), "term")


# --- spelling, suggestions, logs, evaluation -----------------------------------------------------


def levenshtein_nearest(spark, d):
    words = spark.createDataFrame([(w, text.stem(w)) for w in MISSPELT if len(w) >= 2 and w not in text.STOPWORDS], "word string, stem string")
    return spelling.nearest_terms(words, index(spark, d).terms).select("word", "best", F.col("distance").cast("long").alias("distance"))


def did_you_mean(spark, d):
    told = spelling.did_you_mean(index(spark, d), dict(enumerate(MISSPELT)))
    return spark.createDataFrame(list(told.items()), "qid long, suggestion string")


def suggest_prefix(spark, d):
    return analytics.suggest(index(spark, d), "Li", 10)


def popular_terms(spark, d):
    return analytics.popular_terms(log(spark, d))


def top_queries(spark, d):
    return analytics.top_queries(log(spark, d))


def index_stats(spark, d):
    return analytics.index_stats(index(spark, d)).select("pages", six("avg_pagerank").alias("avg_pagerank"), "vocabulary")


def vocabulary_fallback(spark, d):
    return docs(spark, d).select(F.explode(text.raw_tokens(F.col("body"))).alias("t")).agg(F.count_distinct("t").alias("vocabulary"))


JUDGED = {1: ["/en/"], 3: ["/de/", "/fr/"], 5: ["/en/"], 9: ["/en/"]}


def relevance(spark, d):
    hits = search.search_batch(index(spark, d), {i: SEARCHES[i] for i in JUDGED}, 5)
    expected = spark.createDataFrame(list(JUDGED.items()), "qid long, expected array<string>")
    return analytics.relevance(hits.select("qid", "url", "rank"), expected).select("qid", six("p_at_k").alias("p_at_k"), six("rr").alias("rr"))


def mrr(spark, d):
    return relevance(spark, d).agg(six(F.avg("p_at_k")).alias("p_at_5"), six(F.avg("rr")).alias("mrr"), F.count(F.lit(1)).alias("n"))


# --- pages ---------------------------------------------------------------------------------------


def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.text_of(F.col("html")).alias("text"))


def html_hrefs(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(html.hrefs_of(F.col("html")), " ").alias("hrefs"))


def html_outlinks(spark, d):
    """Links of the page's html, and of a tail with a link of each kind, since few of the pages' own resolve."""
    i = F.col("page_id").cast("string")
    tail = F.concat(
        F.lit('<a href="p'), i, F.lit('">1</a> <A class="x" HREF=\'A'), i, F.lit("'>2</A> <a href=\"#top\">3</a> <a href=\""),
        F.lit(f"{HOST}/x/p"), i, F.lit(f'/">4</a> <a href="{HOST}/y/b7?z=1">5</a> <a href="'), F.col("url"), F.lit('">6</a>'),
    )
    page = F.concat(F.coalesce("html", F.lit("")), tail)
    return table(spark, d, "pages").select("page_id", F.array_join(html.outlinks_of(page), " ").alias("outlinks"))


def robots_filter(spark, d):
    return table(spark, d, "pages").select("page_id", html.is_allowed(F.col("url"), ("/de/", "/fr/1")).alias("allowed"))


def topic_of(spark, d):
    return table(spark, d, "pages").select("page_id", html.topic_of(F.col("url")).alias("topic"))


def page_names(spark, d):
    name = html.page_name(F.col("page_id"))
    return table(spark, d, "pages").select("page_id", name.alias("name"), html.page_number(name).alias("number"))


def _page_edges(spark, d) -> DataFrame:
    ids = table(spark, d, "pages").select("page_id")
    n = ids.count()
    return ids.select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 7 + 3) % n, (F.col("page_id") * 3 + 1) % n)).alias("dst"))


def bfs_depth(spark, d):
    return crawl.bfs_depths(_page_edges(spark, d), spark.createDataFrame([(0,)], "node long")).select("node", F.col("depth").cast("long").alias("depth"))


def _manifest(spark, d) -> DataFrame:
    edges = _page_edges(spark, d).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("to"))
    rows = table(spark, d, "pages").select("page_id", html.topic_of(F.col("url")).alias("topic")).join(edges, F.col("page_id") == F.col("src"))
    name = html.page_name(F.col("page_id"))
    # a page without a topic has no path: //p0001 would make its name one
    start = F.when(F.col("topic") == "", "?").otherwise(F.concat("topic", F.lit("/")))
    return rows.select(name.alias("id"), F.concat(F.lit(f"{HOST}/"), start, name).alias("url"), F.col("page_id").alias("ord"), F.transform("to", html.page_name).alias("outlinks"))


def default_seeds(spark, d):
    return crawl.default_seeds(_manifest(spark, d)).select("topic", "id")


def crawl_budget(spark, d):
    rows, _ = crawl.crawl(_manifest(spark, d), per_topic=10, disallowed=("/es/",))
    return rows.select("id", "fetch_ord", F.col("round").cast("long").alias("round"), F.col("depth").cast("long").alias("depth"), F.array_join("outlinks", " ").alias("outlinks"))


def index_links(spark, d):
    return tables.links_of(_manifest(spark, d))


def web_search(spark, d):
    """Crawled pages, extracted, indexed and searched."""
    pages = table(spark, d, "pages")
    made = pages.select(F.col("page_id").alias("doc_id"), F.concat(F.lit(f"{HOST}/"), html.topic_of(F.col("url")), F.lit("/"), html.page_name(F.col("page_id"))).alias("url"), html.title_of(F.col("html")).alias("title"), html.text_of(F.col("html")).alias("body"))
    return search.search_batch(tables.build(made), WEB_SEARCHES, 5).select("qid", F.col("rank").cast("long").alias("rank"), "id", "url", "title")


# --- links ---------------------------------------------------------------------------------------


def _trade(spark, d) -> DataFrame:
    """A link for each line item, from the customer (twice its key) to the supplier (twice its key, and one)."""
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey").cast("long") * 2).alias("src"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey").cast("long") * 2 + 1).alias("dst"))
    return items.join(orders, "o_orderkey").select("src", "dst")


def link_degrees(spark, d):
    return analytics.link_degrees(_trade(spark, d))


def _page_rank(tol=0.0, rounds=PAGERANK_ROUNDS, **how):
    """Ranks of customers and suppliers; suppliers, and customers without orders, have no links out."""

    def run(spark, d):
        customers = table(spark, d, "customer").select((F.col("c_custkey").cast("long") * 2).alias("doc_id"))
        nodes = customers.union(table(spark, d, "supplier").select(F.col("s_suppkey").cast("long") * 2 + 1))
        found = pagerank.compute(nodes, _trade(spark, d), tol=tol, max_iter=rounds, **how)
        return found.select("doc_id", F.round("pagerank", 10).alias("pagerank"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokens": tokens, "stems": stems, "stopword_filter": stopword_filter, "postings": postings, "term_df": term_df,
    "surface_forms": surface_forms, "doc_lengths": doc_lengths, "corpus_stats": corpus_stats, "query_parse": query_parse,
    "term_search_and": _candidates(1, 8), "phrase_search": _candidates(2), "or_groups": _candidates(3, 6, 7),
    "exclusion": _candidates(4, 10), "site_filter": _candidates(5, 7), "idf": idf, "bm25_body": _bm25_of("body"),
    "bm25_title": _bm25_of("title"), "bm25_scores": bm25_scores, "minmax_blend": blend, "search_topn": search_topn,
    "search_batch": search_batch, "snippets": snippets, "levenshtein_nearest": levenshtein_nearest,
    "did_you_mean": did_you_mean, "suggest_prefix": suggest_prefix, "popular_terms": popular_terms,
    "top_queries": top_queries, "index_stats": index_stats, "vocabulary_fallback": vocabulary_fallback,
    "precision_at_k": relevance, "mrr": mrr, "html_title": html_title, "html_text": html_text, "html_hrefs": html_hrefs,
    "html_outlinks": html_outlinks, "robots_filter": robots_filter, "topic_of": topic_of, "page_names": page_names,
    "bfs_depth": bfs_depth, "default_seeds": default_seeds, "crawl_budget": crawl_budget, "web_search": web_search,
    "link_degrees": link_degrees, "pagerank": _page_rank(), "pagerank_by_joins": _page_rank(in_memory=0),
    "pagerank_tol": _page_rank(tol=0.01, rounds=100), "search_hits": search_hits, "index_links": index_links,
}


# --- SQL -----------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_KEPT = f"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}))"
_DOCS = f"""
docs AS (
  SELECT doc_id, '{HOST}/' || lang || '/' || doc_id AS url,
         regexp_extract(coalesce(text, ''), '{TITLE}') AS title, coalesce(text, '') AS body
  FROM documents
)"""


def _index_sql(docs_sql: str) -> str:
    return f"""{docs_sql}, fields AS (
  SELECT doc_id, 'title' AS field, title AS t FROM docs UNION ALL SELECT doc_id, 'body', body FROM docs
), runs AS (SELECT doc_id, field, {_KEPT.format(t="t")} AS ws FROM fields),
kept AS (SELECT doc_id, field, unnest(ws) AS raw, (generate_subscripts(ws, 1) - 1)::INT AS pos FROM runs),
tokens AS MATERIALIZED ({text.stem_sql("kept")}),
postings AS MATERIALIZED (SELECT term, doc_id, field, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY term, doc_id, field),
forms AS (
  SELECT term, raw, count(*) AS n,
         min((doc_id, CASE field WHEN 'title' THEN 0 ELSE 1 END, pos)) AS first
  FROM tokens GROUP BY term, raw
), terms AS MATERIALIZED (
  SELECT t.term, t.df, f.surface
  FROM (SELECT term, count(DISTINCT doc_id) AS df FROM tokens GROUP BY term) t
  JOIN (SELECT term, raw AS surface FROM forms QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, first) = 1) f ON f.term = t.term
), lengths AS MATERIALIZED (
  SELECT d.doc_id, d.url, d.title, d.body, b.n AS body_len, t.n AS title_len
  FROM docs d
  JOIN (SELECT doc_id, len(ws) AS n FROM runs WHERE field = 'body') b ON b.doc_id = d.doc_id
  JOIN (SELECT doc_id, len(ws) AS n FROM runs WHERE field = 'title') t ON t.doc_id = d.doc_id
), stats AS (SELECT count(*) AS n, avg(body_len) AS body, avg(title_len) AS title FROM lengths),
ranks AS (SELECT doc_id, (doc_id * 37 % 101 + 1) / 1000.0::DOUBLE AS pagerank FROM docs),
log AS (SELECT conv_id * 1000 + turn AS ts, text AS query FROM conversations WHERE role = 'user')"""


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]" if v else "[]::VARCHAR[]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


_IDF = "ln(1 + ((SELECT n FROM stats) - df + 0.5) / (df + 0.5))"


def _bm25_sql(length: str, mean: str) -> str:
    return f"(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * {length} / (SELECT {mean} FROM stats))))"


#: What the parser must make of SEARCHES, written by hand: qid, group, clause, phrase, excluded, terms of the clause, place, term.
PARSED = [
    (1, 0, 0, False, False, 1, 0, "licens"),
    (2, 0, 0, True, False, 3, 0, "general"),
    (2, 0, 0, True, False, 3, 1, "public"),
    (2, 0, 0, True, False, 3, 2, "licens"),
    (3, 0, 0, False, False, 1, 0, "licens"),
    (3, 0, 1, False, False, 1, 0, "apach"),
    (3, 1, 2, False, False, 1, 0, "releas"),
    (3, 1, 3, False, False, 1, 0, "mit"),
    (4, 0, 0, False, False, 1, 0, "licens"),
    (4, -1, 1, False, True, 1, 0, "apach"),
    (5, 0, 0, False, False, 1, 0, "licens"),
    (6, 0, 0, True, False, 2, 0, "mit"),
    (6, 0, 0, True, False, 2, 1, "licens"),
    (6, 1, 1, True, False, 2, 0, "apach"),
    (6, 1, 1, True, False, 2, 1, "licens"),
    (6, -1, 2, True, True, 1, 0, "version"),
    (7, 0, 0, False, False, 1, 0, "tion"),
    (7, 0, 1, False, False, 1, 0, "und"),
    (7, 1, 2, False, False, 1, 0, "que"),
    (7, 1, 3, False, False, 1, 0, "les"),
    (8, 0, 0, False, False, 1, 0, "licens"),
    (8, 0, 1, False, False, 1, 0, "licens"),
    (8, 0, 2, False, False, 1, 0, "releas"),
    (10, -1, 0, False, True, 1, 0, "licens"),
    (11, 0, 0, False, False, 1, 0, "track"),
    (11, 1, 1, False, False, 1, 0, "licens"),
    (12, 0, 0, False, False, 1, 0, "und"),
    (12, 0, 1, False, False, 1, 0, "der"),
]
#: Site and words to mark, longest first, by qid; as written by hand.
ASKED = {
    1: (None, ["license"]),
    2: (None, ["general", "license", "public"]),
    3: (None, ["licensed", "released", "apache", "mit"]),
    4: (None, ["license"]),
    5: ("en", ["license"]),
    6: (None, ["license", "apache", "mit", "the"]),
    7: ("de", ["tion", "les", "que", "und"]),
    8: (None, ["released", "license"]),
    9: (None, []),
    10: (None, []),
    11: (None, ["license", "track"]),
    12: ("de", ["der", "und"]),
}


def _search_sql(searches: dict[int, str], docs_sql: str = _DOCS, rank: str = "ranks") -> str:
    asked = [(qid, q, *ASKED[qid]) for qid, q in searches.items()]
    return f"""{_index_sql(docs_sql)},
parsed(qid, grp, clause, phrase, neg, n_terms, place, term) AS (VALUES {_values(r for r in PARSED if r[0] in searches)}),
asked(qid, query, site, marks) AS (VALUES {_values(asked)}),
matched AS (
  SELECT qid, grp, clause, phrase, neg, doc_id FROM parsed JOIN postings USING (term) WHERE NOT phrase
  GROUP BY qid, grp, clause, phrase, neg, n_terms, doc_id HAVING count(DISTINCT place) = n_terms
  UNION
  SELECT qid, grp, clause, phrase, neg, doc_id FROM (SELECT *, unnest(positions) AS at_ FROM parsed JOIN postings USING (term) WHERE phrase)
  GROUP BY qid, grp, clause, phrase, neg, n_terms, doc_id, field, at_ - place HAVING count(DISTINCT place) = n_terms
), groups AS (
  SELECT m.qid, m.grp, m.doc_id FROM matched m
  JOIN (SELECT qid, grp, count(DISTINCT clause) AS n FROM parsed WHERE NOT neg GROUP BY qid, grp) w ON w.qid = m.qid AND w.grp = m.grp
  WHERE NOT m.neg GROUP BY m.qid, m.grp, m.doc_id, w.n HAVING count(DISTINCT m.clause) = w.n
), cand AS MATERIALIZED (
  SELECT DISTINCT g.qid, g.doc_id FROM groups g JOIN asked a ON a.qid = g.qid JOIN docs d ON d.doc_id = g.doc_id
  WHERE (a.site IS NULL OR contains(lower(d.url), '/' || a.site || '/'))
    AND NOT EXISTS (SELECT 1 FROM matched x WHERE x.neg AND x.qid = g.qid AND x.doc_id = g.doc_id)
), scored AS MATERIALIZED (
  SELECT c.qid, c.doc_id,
         sum(q.times * {_IDF} * CASE p.field WHEN 'title' THEN 2.0 * {_bm25_sql("title_len", "title")} ELSE {_bm25_sql("body_len", "body")} END)
         * CASE WHEN EXISTS (SELECT 1 FROM matched x WHERE x.phrase AND NOT x.neg AND x.qid = c.qid AND x.doc_id = c.doc_id) THEN 1.5 ELSE 1.0 END AS bm25
  FROM cand c JOIN (SELECT qid, term, count(*) AS times FROM parsed WHERE NOT neg GROUP BY qid, term) q ON q.qid = c.qid
  JOIN postings p ON p.term = q.term AND p.doc_id = c.doc_id JOIN terms t ON t.term = q.term JOIN lengths l ON l.doc_id = c.doc_id
  GROUP BY c.qid, c.doc_id
), ends AS (
  SELECT s.qid, s.doc_id, bm25, coalesce(pagerank, 0.0) AS pr, min(bm25) OVER w AS lo, max(bm25) OVER w AS hi,
         min(coalesce(pagerank, 0.0)) OVER w AS plo, max(coalesce(pagerank, 0.0)) OVER w AS phi
  FROM scored s LEFT JOIN {rank} r ON r.doc_id = s.doc_id WINDOW w AS (PARTITION BY s.qid)
), blended AS (
  SELECT qid, doc_id, 0.7 * CASE WHEN lo = hi THEN 1.0 ELSE (bm25 - lo) / (hi - lo) END
                    + 0.3 * CASE WHEN plo = phi THEN 1.0 ELSE (pr - plo) / (phi - plo) END AS score
  FROM ends
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM blended)"""


def _some(*ids: int) -> dict[int, str]:
    return {i: SEARCHES[i] for i in ids or SEARCHES}


_ENTITIES = "".join(f"replace(" for _ in (*html.COMMON_ENTITIES, "&amp;")) + "{t}" + "".join(f", {_literal(e)}, {_literal(c)})" for e, c in html.COMMON_ENTITIES.items()) + ", '&amp;', '&')"
_FOLD = r"trim(regexp_replace({t}, '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_TITLE = _FOLD.format(t=_ENTITIES.format(t=r"regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '<[^>]+>', '', 'g')"))
_TEXT = _FOLD.format(t=_ENTITIES.format(t=r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g')"))
_PATH = r"coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_TOPIC = f"split_part(regexp_replace({_PATH}, '^/+', ''), '/', 1)"
_TRADE = """trade AS (
  SELECT o_custkey::BIGINT * 2 AS src, l_suppkey::BIGINT * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
_HREF = r"""'(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']'"""
_TAIL = (
    """'<a href="p' || page_id || '">1</a> <A class="x" HREF=''A' || page_id || '''>2</A> <a href="#top">3</a> <a href="'"""
    f"""|| '{HOST}/x/p' || page_id || '/">4</a> <a href="{HOST}/y/b7?z=1">5</a> <a href="' || url || '">6</a>'"""
)
_ID = "lower(left({x}, 1)) || CASE WHEN length(ltrim(substr({x}, 2), '0')) >= 4 THEN ltrim(substr({x}, 2), '0') ELSE lpad(ltrim(substr({x}, 2), '0'), 4, '0') END"
_LAST = "string_split(regexp_replace(" + _PATH.replace("url", "trim(h)") + ", '/+$', ''), '/')[-1]"
_RESOLVED = f"""CASE WHEN regexp_full_match(trim(h), '[a-zA-Z][0-9]+') THEN {_ID.format(x="trim(h)")}
     WHEN starts_with(trim(h), '{HOST}') AND regexp_full_match({_LAST}, '[a-zA-Z][0-9]+') THEN {_ID.format(x=_LAST)} END"""
#: Nodes and links as one step: all loose nodes' rank goes to all nodes alike, so it is summed once a step.
_WALK = _TRADE + """, edges AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS weight FROM trade GROUP BY src, dst),
ids AS (SELECT c_custkey::BIGINT * 2 AS node FROM customer UNION ALL SELECT s_suppkey::BIGINT * 2 + 1 FROM supplier),
nodes AS MATERIALIZED (SELECT node, node NOT IN (SELECT src FROM edges) AS loose, count(*) OVER () AS n FROM ids),
walk(step, node, rank) AS (
  SELECT 0, node, 1.0::DOUBLE / n FROM nodes
  UNION ALL
  SELECT w.step + 1, x.node, 0.85 * (coalesce(c.coming, 0) + coalesce(any_value(l.mass), 0) / x.n) + 0.15 / x.n
  FROM (SELECT DISTINCT step FROM walk) w CROSS JOIN nodes x
  LEFT JOIN (SELECT e.dst, sum(v.rank * e.weight) AS coming FROM walk v JOIN edges e ON e.src = v.node GROUP BY e.dst) c ON c.dst = x.node
  CROSS JOIN (SELECT sum(CASE WHEN s.loose THEN v.rank END) AS mass FROM walk v JOIN nodes s ON s.node = v.node) l
  WHERE w.step < {rounds} GROUP BY w.step, x.node, x.n, c.coming
)"""
_EDGES = "edges AS (SELECT page_id AS src, unnest([(page_id * 7 + 3) % (SELECT count(*) FROM pages), (page_id * 3 + 1) % (SELECT count(*) FROM pages)]) AS dst FROM pages)"
_WEB = f"""docs AS (
  SELECT page_id AS doc_id, '{HOST}/' || {_TOPIC} || '/' || format('p{{:04d}}', page_id) AS url, {_TITLE} AS title, {_TEXT} AS body FROM pages
)"""
_NEAREST = f"""asked2(word, stem) AS (VALUES {_values((w, text.stem(w)) for w in MISSPELT if len(w) >= 2 and w not in text.STOPWORDS)}),
nearest AS (
  SELECT word, coalesce(surface, terms.term) AS best, levenshtein(stem, terms.term) AS distance
  FROM asked2 JOIN terms ON abs(length(terms.term) - length(stem)) <= 2
  WHERE stem NOT IN (SELECT term FROM terms) AND levenshtein(stem, terms.term) <= CASE WHEN length(stem) <= 4 THEN 1 ELSE 2 END
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, terms.term) = 1
)"""
_POPULAR = f"""latest AS (SELECT query FROM log ORDER BY ts DESC, query LIMIT {analytics.LOG_ROWS}),
log_kept AS (SELECT unnest({_KEPT.format(t="query")}) AS raw FROM latest),
log_stems AS ({text.stem_sql("log_kept")}),
popular AS (SELECT term, count(*) AS n FROM log_stems GROUP BY term ORDER BY n DESC, term LIMIT {analytics.LOG_TERMS})"""
_SNIPPET = f"""shown AS (
  SELECT r.qid, r.rank, format('p{{:04d}}', r.doc_id) AS id, d.url, d.title, a.marks, {_FOLD.format(t="d.body")} AS t
  FROM ranked r JOIN docs d ON d.doc_id = r.doc_id JOIN asked a ON a.qid = r.qid WHERE r.rank <= 5
), placed AS (
  SELECT *, greatest(coalesce(list_min(list_filter(list_transform(marks, lambda w: instr(lower(t), w)), lambda i: i > 0)) - 1 - {LEAD}, 0), 0) AS start FROM shown
)"""
_RELEVANCE = f"""judged(qid, expected) AS (VALUES {_values(JUDGED.items())}),
marked AS (
  SELECT r.qid, r.rank, len(list_filter(j.expected, lambda e: contains(d.url, e))) > 0 AS good
  FROM ranked r JOIN docs d ON d.doc_id = r.doc_id JOIN judged j ON j.qid = r.qid WHERE r.rank <= 5
), told AS (
  SELECT j.qid::BIGINT AS qid, round(coalesce(count(*) FILTER (WHERE m.good) / 5.0, 0), 6)::DOUBLE AS p_at_k,
         round(coalesce(1.0 / min(m.rank) FILTER (WHERE m.good), 0), 6)::DOUBLE AS rr
  FROM judged j LEFT JOIN marked m ON m.qid = j.qid GROUP BY j.qid
)"""
_RANKED = "SELECT qid::BIGINT AS qid, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM ranked WHERE rank <= 10"


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def _cand_sql(*ids: int) -> str:
    return _with(_search_sql(_some(*ids)), "SELECT qid::BIGINT AS qid, doc_id FROM cand")


def _bm25_query(field: str) -> str:
    weight = "2.0 * " if field == "title" else ""
    return _with(
        _index_sql(_DOCS),
        f"SELECT p.term, p.doc_id, round({weight}{_IDF} * {_bm25_sql(field + '_len', field)}, 6) AS score FROM postings p JOIN terms t ON t.term = p.term "
        f"JOIN lengths l ON l.doc_id = p.doc_id WHERE p.field = '{field}'",
    )


def _crawl_sql(per_topic: int, rounds: int) -> str:
    """The crawl with its rounds written out: DuckDB has no windows over a recursion's own rows."""
    name = "format('p{:04d}', {x})"
    steps = [
        f"""{_EDGES},
page AS MATERIALIZED (SELECT page_id, {_TOPIC} AS topic FROM pages),
link AS MATERIALIZED (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place
  FROM (SELECT DISTINCT src, dst FROM edges) JOIN page p ON p.page_id = dst
), ok AS (SELECT src, dst, place FROM link JOIN page ON page_id = dst WHERE topic <> 'es'),
queue1 AS (
  SELECT page_id, topic, 0 AS child, '' AS a, row_number() OVER (ORDER BY topic) AS b, 0::BIGINT AS c, 0 AS depth
  FROM (SELECT topic, min(page_id) AS page_id FROM page WHERE topic NOT IN ('', 'admin') GROUP BY topic)
  WHERE topic <> 'es'
), seen1 AS MATERIALIZED (SELECT min(page_id) AS page_id FROM page WHERE topic NOT IN ('', 'admin') GROUP BY topic)"""
    ]
    for i in range(1, rounds + 1):
        steps.append(f"""turn{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY child, a, b, c) AS turn FROM queue{i}),
new{i} AS MATERIALIZED (
  SELECT dst AS page_id, min((t.topic, t.turn, k.place)) AS first, arg_min(t.depth, (t.topic, t.turn, k.place)) + 1 AS depth
  FROM turn{i} t JOIN ok k ON k.src = t.page_id WHERE t.turn <= {per_topic} AND dst NOT IN (SELECT page_id FROM seen{i}) GROUP BY dst
), seen{i + 1} AS MATERIALIZED (SELECT page_id FROM seen{i} UNION ALL SELECT page_id FROM new{i}),
queue{i + 1} AS MATERIALIZED (
  SELECT page_id, topic, 0 AS child, topic AS a, turn AS b, 0::BIGINT AS c, depth FROM turn{i} WHERE turn > {per_topic}
  UNION ALL SELECT n.page_id, p.topic, 1, n.first[1], n.first[2], n.first[3], n.depth FROM new{i} n JOIN page p ON p.page_id = n.page_id
)""")
    took = " UNION ALL ".join(f"SELECT page_id, {i} AS round, topic, turn, depth FROM turn{i} WHERE turn <= {per_topic}" for i in range(1, rounds + 1))
    steps.append(f"took AS ({took}), out_ AS (SELECT src, string_agg({name.replace('{x}', 'dst')}, ' ' ORDER BY place) AS outlinks FROM ok GROUP BY src)")
    select = f"""SELECT {name.replace('{x}', 'page_id')} AS id, (row_number() OVER (ORDER BY round, topic, turn) - 1)::BIGINT AS fetch_ord,
round::BIGINT AS round, depth::BIGINT AS depth, coalesce(outlinks, '') AS outlinks FROM took LEFT JOIN out_ ON src = page_id"""
    return _with(", ".join(steps), select)


#: Rounds that the SQL of crawl_budget writes out; up to sf0.01 the crawl ends before, on larger tables it goes on.
CRAWL_ROUNDS = 25

_I = _index_sql(_DOCS)
ORACLE_SQL: dict[str, str] = {
    "tokens": _with(_I, "SELECT doc_id, field, raw, term, pos FROM tokens"),
    "stems": _with(f"{_DOCS}, raws AS (SELECT DISTINCT unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS raw FROM docs)", f"SELECT raw, term FROM ({text.stem_sql('raws')})"),
    "stopword_filter": _with(_DOCS, f"SELECT doc_id, len(regexp_extract_all(lower(body), '[a-z0-9]+'))::BIGINT AS n_raw, len({_KEPT.format(t='body')})::BIGINT AS n_kept FROM docs"),
    "postings": _with(_I, "SELECT term, doc_id, field, tf::BIGINT AS tf, array_to_string(positions, ',') AS positions FROM postings"),
    "term_df": _with(_I, "SELECT term, df::BIGINT AS df FROM terms"),
    "surface_forms": _with(_I, "SELECT term, surface FROM terms"),
    "doc_lengths": _with(_I, "SELECT doc_id, body_len::BIGINT AS body_len, title_len::BIGINT AS title_len FROM lengths"),
    "corpus_stats": _with(_I, "SELECT n::BIGINT AS n_docs, round(body, 6) AS avg_body, round(title, 6) AS avg_title FROM stats"),
    "query_parse": f"SELECT qid::BIGINT AS qid, grp::BIGINT AS grp, clause::BIGINT AS clause, phrase, neg, place::BIGINT AS place, term FROM (VALUES {_values(r for r in PARSED if r[0] in SEARCHES)}) t(qid, grp, clause, phrase, neg, n_terms, place, term)",
    "term_search_and": _cand_sql(1, 8),
    "phrase_search": _cand_sql(2),
    "or_groups": _cand_sql(3, 6, 7),
    "exclusion": _cand_sql(4, 10),
    "site_filter": _cand_sql(5, 7),
    "idf": _with(_I, f"SELECT term, round({_IDF}, 6) AS idf FROM terms"),
    "bm25_body": _bm25_query("body"),
    "bm25_title": _bm25_query("title"),
    "bm25_scores": _with(_search_sql(SEARCHES), "SELECT qid::BIGINT AS qid, doc_id, round(bm25, 6) AS bm25 FROM scored"),
    "minmax_blend": _with(_search_sql(SEARCHES), "SELECT qid::BIGINT AS qid, doc_id, round(score, 6) AS score FROM blended"),
    "search_topn": _with(_search_sql(_some(1)), _RANKED),
    "search_batch": _with(_search_sql(SEARCHES), _RANKED),
    "snippets": _with(
        f"{_search_sql(_some(1, 2, 3))}, {_SNIPPET}",
        f"SELECT qid::BIGINT AS qid, rank::BIGINT AS rank, id, url, title, regexp_replace(CASE WHEN start > 0 THEN '…' ELSE '' END || substr(t, start + 1, {LENGTH}) "
        f"|| CASE WHEN start + {LENGTH} < length(t) THEN '…' ELSE '' END, '(?i)(' || array_to_string(marks, '|') || ')', '<mark>\\1</mark>', 'g') AS snippet FROM placed",
    ),
    "levenshtein_nearest": _with(f"{_I}, {_NEAREST}", "SELECT word, best, distance::BIGINT AS distance FROM nearest"),
    "did_you_mean": _with(f"{_I}, {_NEAREST}", f"SELECT q.qid::BIGINT AS qid, n.best AS suggestion FROM (VALUES {_values(enumerate(MISSPELT))}) q(qid, word) LEFT JOIN nearest n ON n.word = q.word"),
    "suggest_prefix": _with(f"{_I}, {_POPULAR}", "SELECT DISTINCT word FROM (SELECT lower(surface) AS word FROM terms WHERE surface <> '' UNION ALL SELECT coalesce(t.surface, p.term) FROM popular p LEFT JOIN terms t ON t.term = p.term) WHERE starts_with(word, 'li') ORDER BY word LIMIT 10"),
    "popular_terms": _with(f"log AS (SELECT conv_id * 1000 + turn AS ts, text AS query FROM conversations WHERE role = 'user'), {_POPULAR}", "SELECT term, n::BIGINT AS n FROM popular"),
    "top_queries": "SELECT text AS query, count(*)::BIGINT AS n FROM conversations WHERE role = 'user' GROUP BY text ORDER BY n DESC, query LIMIT 10",
    "index_stats": _with(_I, "SELECT (SELECT count(*) FROM docs)::BIGINT AS pages, (SELECT round(avg(pagerank), 6) FROM ranks) AS avg_pagerank, (SELECT count(*) FROM terms)::BIGINT AS vocabulary"),
    "vocabulary_fallback": "SELECT count(DISTINCT t)::BIGINT AS vocabulary FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents)",
    "precision_at_k": _with(f"{_search_sql(_some(*JUDGED))}, {_RELEVANCE}", "SELECT qid, p_at_k, rr FROM told"),
    "mrr": _with(f"{_search_sql(_some(*JUDGED))}, {_RELEVANCE}", "SELECT round(avg(p_at_k), 6) AS p_at_5, round(avg(rr), 6) AS mrr, count(*)::BIGINT AS n FROM told"),
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_text": f"SELECT page_id, {_TEXT} AS text FROM pages",
    "html_hrefs": f"SELECT page_id, array_to_string(regexp_extract_all(coalesce(html, ''), {_HREF}, 1), ' ') AS hrefs FROM pages",
    "html_outlinks": f"""WITH found AS (SELECT page_id, regexp_extract_all(coalesce(html, '') || {_TAIL}, {_HREF}, 1) AS hrefs FROM pages),
named AS (SELECT page_id, list_filter(list_transform(hrefs, lambda h: {_RESOLVED}), lambda x: x IS NOT NULL) AS ids FROM found)
SELECT page_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ' ') AS outlinks FROM named""",
    "robots_filter": f"SELECT page_id, NOT (starts_with({_PATH}, '/de/') OR starts_with({_PATH}, '/fr/1')) AS allowed FROM pages",
    "topic_of": f"SELECT page_id, {_TOPIC} AS topic FROM pages",
    "page_names": "SELECT page_id, format('p{:04d}', page_id) AS name, page_id AS number FROM pages",
    "bfs_depth": _with(f"{_EDGES}, reach(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.depth < 40)", "SELECT node, min(depth)::BIGINT AS depth FROM reach GROUP BY node", True),
    "default_seeds": f"SELECT topic, format('p{{:04d}}', min(page_id)) AS id FROM (SELECT page_id, {_TOPIC} AS topic FROM pages) WHERE topic NOT IN ('', 'admin') GROUP BY topic",
    "crawl_budget": _crawl_sql(10, CRAWL_ROUNDS),
    "web_search": _with(_search_sql(WEB_SEARCHES, _WEB, "(SELECT doc_id, 0.0 AS pagerank FROM docs)"), "SELECT r.qid::BIGINT AS qid, r.rank::BIGINT AS rank, format('p{:04d}', r.doc_id) AS id, d.url, d.title FROM ranked r JOIN docs d ON d.doc_id = r.doc_id WHERE r.rank <= 5"),
    "link_degrees": _with(_TRADE, "SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM trade UNION ALL SELECT dst, 0, 1 FROM trade) GROUP BY node"),
    "pagerank": _with(_WALK.format(rounds=PAGERANK_ROUNDS), f"SELECT node AS doc_id, round(rank / sum(rank) OVER (), 10) AS pagerank FROM walk WHERE step = {PAGERANK_ROUNDS}", True),
    # the first step that moves ranks by less than the tolerance
    "pagerank_tol": _with(
        _WALK.format(rounds=30) + """, moved AS (SELECT step FROM walk JOIN (SELECT step + 1 AS step, node, rank AS before FROM walk) USING (step, node) GROUP BY step HAVING sum(abs(rank - before)) < 0.01)""",
        "SELECT node AS doc_id, round(rank / sum(rank) OVER (), 10) AS pagerank FROM walk WHERE step = (SELECT min(step) FROM moved)",
        True,
    ),
    "search_hits": _with(_search_sql(SEARCHES), "SELECT qid::BIGINT AS qid, rank::BIGINT AS rank, format('p{:04d}', doc_id) AS id, round_even(score, 4)::DOUBLE AS score FROM ranked WHERE rank <= 10"),
    "index_links": _with(_EDGES, "SELECT src, dst FROM (SELECT DISTINCT src, dst FROM edges) JOIN pages ON page_id = dst"),
}
ORACLE_SQL["pagerank_by_joins"] = ORACLE_SQL["pagerank"]
