import pytest
from pyspark.sql import functions as F

from quarry.functions import html, text
from quarry.plans.query import parse, terms_of

WORDS = "classes stories runs jazz bus glass running cooking stopped played bake baked quickly only recipe recipes ties falling sing bed sses seed hugged lying ss us agreed red fully".split()


def test_stems():
    want = {"classes": "class", "stories": "stori", "runs": "run", "jazz": "jazz", "bus": "bus", "running": "run", "cooking": "cook", "stopped": "stop", "played": "play", "bake": "bak", "baked": "bak", "quickly": "quick", "ties": "ti", "recipes": "recip", "recipe": "recip"}
    assert {w: text.stem(w) for w in want} == want


def test_engine_and_driver_stem_alike(spark):
    rows = text.with_stem(spark.createDataFrame([(w,) for w in WORDS], "raw string")).collect()
    assert {r.raw: r.term for r in rows} == {w: text.stem(w) for w in WORDS}


def test_kept_tokens(spark):
    df = spark.createDataFrame([("The cat, a C-3PO; naïve x CATS!",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.kept_tokens(F.col("t"))).collect()] == [["cat", "3po", "na", "ve", "cats"], [], []]


def test_parse():
    q = parse('python -django "black hole" OR jazz site:Space/ -"the cat" list-comp the')
    assert [[c.terms for c in g] for g in q.groups] == [[("python",), ("black", "hol")], [("jazz",), ("list", "comp")]]
    assert [c.terms for c in q.exclude] == [("django",), ("cat",)] and q.site == "space"
    assert q.surface_terms() == ["python", "black", "hole", "jazz", "list", "comp"]
    assert parse("the").groups == [] and parse(None).groups == [] and parse("cats or dogs").groups[0][1].terms == ("dog",)
    assert parse('"a OR b cat" "unbalanced').groups[0][0].terms == ("cat",) or terms_of("b") == []


@pytest.mark.parametrize(("url", "topic", "allowed"), [("https://docs.test/python/p1", "python", True), ("https://docs.test/admin/a1", "admin", False), ("https://docs.test", "", True), ("nonsense", "nonsense", True), ("https://docs.test/admin", "admin", True)])
def test_urls(spark, url, topic, allowed):
    row = spark.createDataFrame([(url,)], "url string").select(html.topic_of(F.col("url")).alias("t"), html.is_allowed(F.col("url")).alias("a")).first()
    assert (row.t, row.a) == (topic, allowed)


PAGE = """<html><head><TITLE x="1"> A &amp;lt; <b>B</b> &eacute; </TITLE><style>p{}</style></head><body><!-- <a href="p9"> -->
<script>var x = "<p>no</p>";</script><p>One&nbsp;two <a class=k href='p7'>x</a> <A HREF="https://docs.test/x/a12/">y</A>
<a href="#top">z</a><a href="p0007">again</a><a href="https://other.test/p3">o</a></p></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), (None,)], "h string")
    got = df.select(html.title_of(F.col("h")).alias("title"), html.text_of(F.col("h")).alias("text"), html.outlinks_of(F.col("h")).alias("out")).collect()
    assert got[0].title == "A &lt; B é"
    assert got[0].text == "A &lt; B é One two x y z again o"
    assert got[0].out == ["p0009", "p0007", "a0012"]
    assert (got[1].title, got[1].text, got[1].out) == ("", "", [])


def test_page_names(spark):
    df = spark.createDataFrame([(1,), (12345,)], "n long").select(html.page_name(F.col("n")).alias("p")).select("p", html.page_number(F.col("p")).alias("n"))
    assert [tuple(r) for r in df.collect()] == [("p0001", 1), ("p12345", 12345)]
    with pytest.raises(Exception, match="bad page id"):
        spark.createDataFrame([("a0001",)], "p string").select(html.page_number(F.col("p"))).collect()
