import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators import analytics, crawl, pagerank, ranking, spelling
from quarry.operators import index as tables
from quarry.plans import search
from quarry.streaming import querylog

PAGES = [
    (1, "python", "Python iterators", "Python iterators walk lists. Iterators in Python are lazy and lovely.", [2, 3]),
    (2, "python", "Django and Python", "Django is a Python framework for web sites with a long history.", [1, 99]),
    (3, "cooking", "Sourdough bread", "Sourdough hydration matters. Bread needs sourdough and time.", [4]),
    (4, "cooking", "Soup", "A soup of beans and herbs for winter.", []),
    (5, "jazz", "Bebop", "Bebop scales run fast over changing chords.", [6]),
    (6, "space", "Black holes", "A black hole bends light. The hole is black.", [5]),
    (7, "basketball", "Mascots", "The cat sat on the mat while the dog watched.", []),
    (8, "basketball", "Mascots again", "A sat cat is a calm cat.", []),
]


def pages(spark):
    rows = [(f"p{i:04d}", f"https://docs.test/{t}/p{i:04d}", title, body, [f"p{o:04d}" for o in out]) for i, t, title, body, out in PAGES]
    return spark.createDataFrame(rows, "id string, url string, title string, text string, outlinks array<string>")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    tables.write(tables.build(tables.docs_of(pages(spark)), tables.links_of(pages(spark))), path)
    made = tables.read(spark, path)
    tables.write_pagerank(pagerank.compute(made.docs, made.links), path)
    return tables.read(spark, path)


def ids(hits):
    return [h["id"] for h in hits]


def test_index(spark, index):
    assert tables.counts(index)["docs"] == 8 and index.links.count() == 6
    rows = {r.term: r for r in index.postings.where("doc_id = 7 AND field = 'body'").collect()}
    assert rows["cat"].positions == [0] and rows["mat"].positions == [2] and rows["watch"].positions == [5]
    assert index.docs.where("doc_id = 7").first().body_len == 6
    assert index.terms.where("term = 'iterator'").first().surface == "iterators"
    assert index.terms.where("term = 'python'").first().df == 2


def test_duplicates_are_refused(spark):
    with pytest.raises(ValueError, match="more than once"):
        tables.check_unique(tables.docs_of(pages(spark).union(pages(spark))))


def test_missing_index_is_empty(spark, tmp_path):
    none = tables.read(spark, str(tmp_path / "none"))
    assert search.search(none, "python") == [] and search.did_you_mean(none, "pythn") is None
    assert search.run_eval(none)["p_at_5"] == 0.0 and analytics.suggest(none, "p").collect() == []


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ('"cat sat"', {"p0007"}), ('"sat cat"', {"p0008"}), ("cat sat", {"p0007", "p0008"}), ("python -django", {"p0001"}), ("sourdough OR bebop", {"p0003", "p0005"}),
        ("python site:cooking", set()), ("python site:Python", {"p0001", "p0002"}), ("the", set()), ("", set()), ("-python", set()), ("site:jazz", set()), ('"hole black"', {"p0006"}), ("pythn", set()), ('python -"python framework"', {"p0001"}),
    ],
)
def test_search(index, query, want):
    hits = search.search(index, query)
    assert set(ids(hits)) == want
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)


def test_phrase_raises_the_score(index):
    b = ranking.Batch(index, {1: "hydration", 2: '"hydration"', 3: "hydration hydration"})
    got = {r.qid: r.bm25 for r in b.scores().collect()}
    assert math.isclose(got[2], 1.5 * got[1]) and math.isclose(got[3], 2 * got[1])


def test_title_beats_body(index):
    assert ids(search.search(index, "soup OR bean"))[0] == "p0004"


def test_snippet_marks(index):
    hit = search.search(index, "hydration")[0]
    assert "<mark>hydration</mark>" in hit["snippet"] and len(hit["snippet"]) <= 200
    long = tables.build(index.docs.limit(1).select("doc_id", "url", "title", F.concat(F.repeat(F.lit("filler "), 50), F.lit("needle "), F.repeat(F.lit("more "), 60)).alias("body")))
    snippet = search.search(long, "needle")[0]["snippet"]
    assert snippet.startswith("…") and snippet.endswith("…") and "<mark>needle</mark>" in snippet


def test_spelling_and_suggestions(spark, index):
    assert search.did_you_mean(index, 'pythn "blck hole" -x OR site:y') == 'python "black hole" -x OR site:y'
    assert search.did_you_mean(index, "python") is None and search.did_you_mean(index, " ") is None
    assert [r.word for r in analytics.suggest(index, "B", 3).collect()] == ["beans", "bebop", "bends"]
    index.query_log = spark.createDataFrame([(dt.datetime(2026, 1, 1), "bananas bananas", 0)], tables.SCHEMAS["query_log"])
    assert [r.word for r in analytics.suggest(index, "ba", 3).collect()] == ["banana"]
    assert analytics.suggest(index, "b", 0).collect() == []


def oracle_ranks(n, links, d=0.85):
    out = {i: [b for a, b in links if a == i] for i in range(n)}
    r = [1 / n] * n
    for _ in range(300):
        new = [(1 - d) / n] * n
        for i in range(n):
            for j in out[i] or range(n):
                new[j] += d * r[i] / (len(out[i]) or n)
        r = new
    return r


@pytest.mark.parametrize(("n", "links"), [(3, [(0, 1), (1, 2), (2, 0)]), (3, [(0, 1), (0, 2), (1, 2)]), (1, []), (5, [(0, 1), (0, 1), (0, 2), (2, 2), (3, 0), (4, 77)])])
def test_pagerank(spark, n, links):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
    want = oracle_ranks(n, [x for x in links if max(x) < n])
    for size in (0, pagerank.IN_MEMORY):
        got = {r.doc_id: r.pagerank for r in pagerank.compute(nodes, spark.createDataFrame(links, "src long, dst long"), in_memory=size).collect()}
        assert math.isclose(sum(got.values()), 1) and all(abs(got[i] - want[i]) < 1e-5 for i in range(n))


def test_pagerank_of_nothing(spark):
    assert pagerank.compute(spark.createDataFrame([], "doc_id long"), spark.createDataFrame([], "src long, dst long")).count() == 0


def manifest(spark):
    rows = [("p0001", "t/a", 0, ["p0002", "p0003", "a0001"]), ("p0002", "t/b", 1, ["p0004", "p0099"]), ("p0003", "u/c", 2, ["p0004", "a0001", "p0001"]), ("p0004", "u/d", 3, ["p0005"]), ("p0005", "u/e", 4, []), ("a0001", "admin/x", 5, ["p0001"])]
    return spark.createDataFrame([(i, f"https://docs.test/{u}", o, out) for i, u, o, out in rows], "id string, url string, ord long, outlinks array<string>")


def test_crawl(spark):
    rows, figures = crawl.crawl(manifest(spark), seeds=["p0001"])
    got = rows.orderBy("fetch_ord").collect()
    assert [r.id for r in got] == ["p0001", "p0002", "p0003", "p0004", "p0005"] and [r.depth for r in got] == [0, 1, 1, 2, 3]
    assert got[0].outlinks == ["p0002", "p0003"] and got[1].outlinks == ["p0004"]
    assert (figures["fetched"], figures["rounds"], figures["skipped_robots"], figures["per_round_max"]) == (5, 4, 2, 1)


def test_crawl_limits(spark):
    rows, figures = crawl.crawl(manifest(spark), max_pages=2)
    assert figures["seeds"] == ["p0001", "p0003"] and figures["fetched"] == 2 and rows.count() == 2
    missing = manifest(spark).withColumn("present", F.col("id") != "p0003")
    _, figures = crawl.crawl(missing, seeds=["p0001", "a0001", "zzz"], per_topic=1)
    assert figures["skipped_missing"] == 1 and figures["fetched"] == 4


def test_relevance(spark):
    hits = spark.createDataFrame([(1, "x/a", 1), (1, "x/b", 2), (1, "y/c", 3), (1, "y", 6)], "qid long, url string, rank int")
    judged = spark.createDataFrame([(1, ["x/b", "y"]), (2, ["z"])], "qid long, expected array<string>")
    got = {r.qid: (r.p_at_k, r.rr) for r in analytics.relevance(hits, judged).collect()}
    assert got == {1: (0.4, 0.5), 2: (0.0, 0.0)}


def test_stream_of_the_log(spark, tmp_path):
    at = dt.datetime(2026, 1, 1, 10)
    rows = [(at + dt.timedelta(minutes=m), q, h) for m, q, h in [(0, "a", 1), (5, "a", 0), (7, "b", 2), (300, "late", 0)]]
    spark.createDataFrame(rows, tables.SCHEMAS["query_log"]).write.parquet(f"{tmp_path}/query_log")
    querylog.write(querylog.query_counts(querylog.read(spark, str(tmp_path))), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r.query, r.n, r.no_hits) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 2, 1), ("b", 1, 0)}


def test_index_versions(spark, tmp_path):
    """Readers see a version whole; one that fails is never seen, and the one before the last is kept."""
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "u1", "one", "first body"), (2, "u2", "two", "second body")], "doc_id long, url string, title string, body string")
    tables.write(tables.build(docs.where("doc_id = 1")), path)
    first = tables.read(spark, path)
    tables.write(tables.build(docs), path)
    broken = tables.build(docs.withColumn("title", F.expr("assert_true(doc_id < 2, 'broken')").cast("string")))
    with pytest.raises(Exception, match="broken"):
        tables.write(broken, path)
    assert first.docs.count() == 1 and tables.read(spark, path).docs.count() == 2
    assert tables.read(spark, path).terms.where("term = 'second'").count() == 1
    tables.write(tables.build(docs.where("doc_id = 2")), path)
    assert [r.doc_id for r in tables.read(spark, path).docs.collect()] == [2]


def test_crawl_numbers_without_one_task(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit("x").alias("s")).repartition(7)
    got = crawl.numbered(rows, ["s", "k"], "at").collect()
    assert len(got) == 500 and all(r["at"] == r.k for r in got)


def test_nearest_terms_by_deletions(spark, monkeypatch):
    """Many words find the same nearest terms as a few."""
    rng = __import__("random").Random(4)
    make = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    terms = sorted({make(rng.randint(1, 8)) for _ in range(300)} | {"x" * 30, "x" * 26 + "y"})
    words = sorted({make(rng.randint(1, 9)) for _ in range(80)} | {"x" * 25, "x" * 24 + "z", "zzzz"})
    vocabulary = spark.createDataFrame([(t, t) for t in terms], "term string, surface string")
    asked = spark.createDataFrame([(w, w) for w in words], "word string, stem string")
    few = sorted(tuple(r) for r in spelling.nearest_terms(asked, vocabulary).collect())
    monkeypatch.setattr(spelling, "FEW", 0)
    assert sorted(tuple(r) for r in spelling.nearest_terms(asked, vocabulary).collect()) == few and len(few) > 30


def test_bfs_depths_of_deep_graphs(spark):
    """Small and large graphs, walked as deep as they are, in few rounds."""
    n = 1_300
    chain = [(i, i + 1) for i in range(n)] + [(5, 3), (7, 7), (9, 11), (9, 11), (None, 4), (4, None), (-1, 2)]
    want = {i: i - (i > 10) for i in range(n + 1)}
    edges, roots = spark.createDataFrame(chain, "src long, dst long"), spark.createDataFrame([(0,), (0,), (None,)], "node long")
    rows = crawl.bfs_depths(edges, roots).collect()
    assert len(rows) == n + 1 and {r.node: r.depth for r in rows} == want
    rng = __import__("random").Random(3)
    links = [(f"n{a}", f"n{b}") for a, b in ((i, min(59, max(0, i + rng.choice([-9, -3, 1, 1, 2])))) for i in range(60) for _ in range(2))] + [("x", "n1")]
    depths, level, depth = {}, {"n0", "n50"}, 0
    while level:
        depths |= dict.fromkeys(level, depth)
        level, depth = {b for a, b in links if a in level} - set(depths), depth + 1
    few = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([("n0",), ("n50",)], "node string")
    for how in ({}, {"in_memory": 0}):
        rows = crawl.bfs_depths(*few, **how)
        assert rows.dtypes == [("node", "string"), ("depth", "int")]
        assert sorted(tuple(r) for r in rows.collect()) == sorted(depths.items()) and max(depths.values()) > 4
    assert sorted(r.depth for r in crawl.bfs_depths(*few, max_depth=2).collect()) == sorted(x for x in depths.values() if x <= 2)
    nothing = edges.where("false")
    for size in (0, 100):
        assert [tuple(r) for r in crawl.bfs_depths(nothing, roots, in_memory=size).collect()] == [(0, 0)]
        assert crawl.bfs_depths(edges, roots.where("false"), in_memory=size).count() == 0


def test_crawl_of_odd_urls_equals_sql(spark, tmp_path):
    """Pages without a topic are one group and no seeds; topics that Java's URL parser rejects are topics, and disallowed ones."""
    urls = ["https://h.test", None, "https://h.test/?q=1", "https://h.test/a b/1", "https://h.test/de|x/2#top", "https://h.test/es/ 3", "https://h.test//fr//4/", "https://h.test/en/5%zz"]
    rows = [(i, urls[i % len(urls)], "") for i in range(24)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("topic_of", "default_seeds", "crawl_budget"):
        found = queries.QUERIES[name](spark, str(tmp_path))
        want = con.sql(queries.ORACLE_SQL[name])
        assert found.columns == want.columns
        assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall()), name
