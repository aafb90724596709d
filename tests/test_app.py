from quarry import cli
from quarry.operators import index as tables
from quarry.plans import search
from quarry.sources import corpus, pages
from quarry.web import App, app_of

HIT = {"id": "p0001", "url": "https://docs.test/x?a=1&b=2", "title": "A <b>", "snippet": "x <mark>y</mark> <i>", "score": 0.5}


def app(log, **kw):
    return App(kw.get("find", lambda q, n: [HIT] * min(n, 2)), lambda q: "bet<ter", lambda q, n: log.append((q, n)), lambda: {"pages": 12, "avg": 0.2, "top": [("q<", 3)]})


def test_routes():
    log = []
    a = app(log)
    assert "12 pages" in a.handle("/")[2] and a.handle("/nowhere")[0] == 404
    status, _, body = a.handle("/search/?q=+cat+&n=zzz")
    assert status == 200 and "A &lt;b&gt;" in body and "<mark>y</mark> &lt;i&gt;" in body and "bet&lt;ter" in body and log == [("cat", 2)]
    assert a.handle("/search?q=")[2].count("Type a query") == 1 and len(log) == 1
    assert "0.200000" in a.handle("/stats/")[2] and "q&lt;" in a.handle("/stats")[2]
    assert a.handle("/search?q=x&n=0")[2].count("<li>") == 1


def test_trouble_is_shown_as_nothing_found():
    log = []
    assert "no index" in app(log, find=None).handle("/search?q=x")[2] and log == [("x", 0)]

    def broken(q, n):
        raise RuntimeError

    assert "Nothing found" in app(log, find=broken).handle("/search?q=x")[2]


def test_arguments():
    args = cli.parser().parse_args(["build"])
    assert (args.seed, args.docs) == (7, 2500)
    assert cli.parser().parse_args(["search", "a b"]).n == 10 and cli.parser().parse_args(["serve"]).port == 8000
    assert "**y**" in cli.shown([HIT], 0.01)


def test_corpus(spark):
    made = corpus.pages(spark, 7, 120)
    rows = {r.id: r for r in made.collect()}
    assert len(rows) == 121 and sum(r.kind == "hub" for r in rows.values()) == 20 and rows["a0001"].kind == "admin"
    assert made.exceptAll(corpus.pages(spark, 7, 120, 3)).count() == 0 and corpus.pages(spark, 8, 120).exceptAll(made).count() > 0
    links = [(r.src, r.dst) for r in corpus.links(made, 7).collect()]
    assert len(links) == len(set(links)) and all(a != b for a, b in links)
    hubs = {(rows[a].topic, b) for a, b in links if rows[a].kind == "hub"}
    assert all((r.topic, r.id) in hubs for r in rows.values() if r.kind != "admin")


def test_build_and_serve(spark, tmp_path, capsys):
    took = search.build(spark, str(tmp_path), 7, 120)
    assert list(took) == ["corpus", "crawl", "index", "pagerank"]
    index = tables.read(spark, f"{tmp_path}/index")
    assert index.docs.count() == 120 and index.docs.where("url LIKE '%/admin/%'").count() == 0
    a = app_of(spark, f"{tmp_path}/index")
    assert "<mark>" in a.handle("/search?q=kiln")[2]
    a.handle("/search?q=kiln")
    assert "kiln</td><td>2" in a.handle("/stats")[2]
    told = search.run_eval(index)
    assert told["n"] == 14 and told["mrr"] > 0.5


def test_frontier_files(spark, tmp_path):
    rows = spark.createDataFrame([("p0002", ["p0001"], "t", "b", "u2", 2), ("p0001", [], "é", "a", "u1", 1)], "id string, outlinks array<string>, text string, title string, url string, fetch_ord long")
    pages.write_frontier(rows, str(tmp_path / "f"))
    assert [r.id for r in pages.read_frontier(spark, str(tmp_path / "f")).orderBy("fetch_ord").collect()] == ["p0001", "p0002"]
    (tmp_path / "m.json").write_text('[{"id": "p0003", "url": "u", "title": "t", "outlinks": ["p0001"]}, {"id": "p0001", "url": "v", "title": "w", "outlinks": []}]')
    assert [(r.id, r.ord) for r in pages.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("p0003", 0), ("p0001", 1)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p0001.html").write_text("<p>x\ny</p>")
    assert [tuple(r) for r in pages.read_pages(spark, str(tmp_path / "pages")).collect()] == [("p0001", "<p>x\ny</p>")]
    site = {r.id: r for r in pages.read_site(spark, str(tmp_path / "m.json"), str(tmp_path / "pages")).collect()}
    assert site["p0001"].present and site["p0001"].html == "<p>x\ny</p>" and not site["p0003"].present and site["p0003"].ord == 0
    crawled, figures = search.crawled(pages.read_site(spark, str(tmp_path / "m.json"), str(tmp_path / "pages")), seeds=["p0003", "p0001"])
    assert figures["skipped_missing"] == 1 and [r.id for r in crawled.collect()] == ["p0001"]
