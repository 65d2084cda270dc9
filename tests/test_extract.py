import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import normal
from webloom.functions import dom, html
from webloom.functions.html import Field, Rule, fields_of
from webloom.plans import registry

SHOP = """<!doctype html><title>Tea &amp; Co</title><section id=list><h2>Green</h2>
<ul class="goods wide"><li data-sku="g1"><b>Sencha</b> <i>4.50</i><li data-sku="g2"><b>Gyokuro</b> <i>19.00</i></ul>
<h2>Black</h2><ul class=goods><li data-sku="b7" lang=en-GB><b>Assam</b> <i>3.25</i></ul>
<nav><a href="/tea/2" rel=next>more</a><a rel=prev>less</a></nav></section><footer>Kettle
 Lane  9</footer>"""


def pick(selector, attr="text", all=False, type="css", page=SHOP):
    return fields_of(page, Rule((("x", Field(selector, attr, all)),), type))[0]["x"]


CSS = {
    "title": ["Tea & Co"], "h2": ["Green", "Black"], ".goods b": ["Sencha", "Gyokuro", "Assam"], "ul.wide > li > i": ["4.50", "19.00"], "#list > h2 + ul b": ["Sencha", "Gyokuro", "Assam"],
    "h2 ~ nav a": ["more", "less"], "li:first-child b": ["Sencha", "Assam"], "li:nth-child(2) b, footer": ["Gyokuro", "Kettle Lane 9"], "li:last-child i": ["19.00", "3.25"],
    "[data-sku^=g] b": ["Sencha", "Gyokuro"], "[data-sku$='7'] b": ["Assam"], "[class~=wide] li b": ["Sencha", "Gyokuro"], "[lang|=en] i": ["3.25"], "a[rel*=ex]": ["more"],
    "* > title": [], "ul + ul": [], "nav > a + a": ["less"], "section li + li b": ["Gyokuro"],
}
XPATH = {
    "//h2": ["Green", "Black"], "//ul[@class='goods']/li/b": ["Assam"], "//ul/li[2]/b": ["Gyokuro"], "//ul/li[last()]/i": ["19.00", "3.25"], "//li[@lang]//b": ["Assam"],
    "//a[contains(@rel, 'ex')]/@href": ["/tea/2"], "//section//a": ["more", "less"], "//nav/a/text()": ["more", "less"], "//section//ul//b": ["Sencha", "Gyokuro", "Assam"],
}


@pytest.mark.parametrize(("kind", "selector"), [("css", s) for s in CSS] + [("xpath", s) for s in XPATH])
def test_selectors(kind, selector):
    want = (CSS if kind == "css" else XPATH)[selector]
    assert pick(selector, all=True, type=kind) == want
    assert pick(selector, type=kind) == (want[:1] or None)


def test_attributes_and_html():
    assert pick("li", "data-sku", all=True) == ["g1", "g2", "b7"] and pick("a", "href", all=True) == ["/tea/2", None]
    assert pick("a:nth-child(2)", "href") is None
    assert pick("nav", "html") == ['<nav><a href="/tea/2" rel="next">more</a><a rel="prev">less</a></nav>']


def test_references():
    """A name that no semicolon ends is text, as lxml with libxml2 2.12 and the queries' SQL have it; numbers need none."""
    page = "<title>Salt &amp; pepper&amp</title><p>a &lt b &notit; c &amp;lt; &#39;&#65 &hellip;</p><a&b href='?x=1&copy=2&amp;y'>t</a&b><script>a && b</script>"
    assert pick("title", page=page) == ["Salt & pepper&amp"]
    assert pick("p", page=page) == ["a &lt b &notit; c &lt; 'A …"]
    assert pick("[href]", "href", page=page) == ["?x=1&copy=2&y"] and pick("script", page=page) == ["a && b"]


def test_xpath_references():
    page = "<html lang='de&amp'><h1>Tee &amp; Zucker&amp</h1><a href='?lt=1&lt=2&gt;'>x &quot</a>"
    one = lambda path: pick(path, type="xpath", page=page)
    assert one("//h1") == ["Tee & Zucker&amp"] and one("//a/text()") == ["x &quot"]
    assert one("//html/@lang") == ["de&amp"] and one("//a/@href") == ["?lt=1&lt=2>"] and one("//a[@href='?lt=1&lt=2>']") == ["x &quot"]


def test_html_as_written():
    """Text and comments stay as the page has them; joined pieces can't become another reference or tag."""
    inner = "a &quot;b&quot; \" &copy; c&a &amp;lt; d&amp <!-- &am --> e > f &am<!---->p; g <<!--x-->i>&#39;"
    assert pick("h1", "html", page=f"<h1>{inner}</h1>") == [f"<h1>{inner}</h1>"]
    again = pick("h1", page=pick("h1", "html", page=f"<h1>{inner}</h1>")[0])
    assert again == pick("h1", page=f"<h1>{inner}</h1>") == ["a \"b\" \" © c&a &lt; d&amp e > f &amp; g <i>'"]
    assert pick("//h1/text()", all=True, type="xpath", page="<h1>a<!--x-->b</h1>") == ["a", "b"]


def test_cut_reference_agrees_with_sql(spark, tmp_path):
    """Titles of larger tables are cut inside a reference."""
    titles = ["Oolong &amp; milk &amp", "5 &lt; 6 &lt", "&quot;Pu&quot; er &quot", "Mate &am", "Rooibos &"]
    pages = [(i, f'<html lang="en"><title>{t}</title><article><h1>{t}</h1><p>x</article></html>') for i, t in enumerate(titles, 1)]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("extract_css_title", "extract_xpath_h1", "extract_outer_html"):
        want = duckdb.connect().sql(registry.ORACLE_SQL[name].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).df()
        assert normal(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(want)


def test_missing_xpath_fields_agree_with_sql(spark, tmp_path):
    """A page may lack its heading, its language or all; only a page without html has NULL."""
    tea = "<h1>Tea &amp; milk &am</h1>"
    pages = [f'<html lang="en">{tea}', f"<html>{tea}", '<html lang="de"><p>x', "<html><p>x", '<html lang=""><h1></h1>', "text", "", None]
    spark.createDataFrame(list(enumerate(pages, 1)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.connect().sql(registry.ORACLE_SQL["extract_xpath_h1"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).df()
    got = registry.QUERIES["extract_xpath_h1"](spark, str(tmp_path)).toPandas()
    assert normal(got) == normal(want)
    assert normal(got)[-1] == ("Tea & milk &am", "en", "1") and ("NULL", "NULL", "8") in normal(got)


@pytest.mark.parametrize("bad", ["", "ul >", "li[", "::before", ":nth-child", "li:first-child(2)", "a b)"])
def test_bad_selectors(bad):
    rule = Rule((("one", Field(bad)), ("many", Field(bad, all=True)), ("none", Field("video")), ("must", Field("video", required=True))))
    data, warnings = fields_of(SHOP, rule)
    assert data == {"one": None, "many": [], "none": None, "must": None}
    assert warnings == ["field 'one': invalid selector", "field 'many': invalid selector", "field 'must': required selector not found"]


def test_tag_soup():
    root = dom.parse("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y")
    assert [e.text() for e in dom.compile_css("ul > li")(root)] == ["a", "bc", "c"]
    assert [len(e.elements()) for e in dom.compile_css("tr")(root)] == [2, 1]
    assert [e.text() for e in dom.compile_css("p")(root)] == ["x", "y"]
    assert fields_of("", Rule((("x", Field("p")),))) is None


def test_deep_and_wide_pages():
    """Neither depth nor the number of siblings makes a selector fail or take quadratic time."""
    n = 100_000
    began = time.perf_counter()
    deep = "<div>" * n + "<b>end</b>"
    assert pick("div div b", page=deep) == ["end"] and pick("//div//b", type="xpath", page=deep) == ["end"]
    assert len(pick("div", "html", page=deep)[0]) == 11 * n + len("<b>end</b>")
    wide = "<ul>" + "<li>x" * n + "<li class=z>y</ul>"
    assert pick("li:last-child", page=wide) == ["y"] and pick("li ~ li.z", page=wide) == ["y"] and pick(f"li:nth-child({n})", page=wide) == ["x"]
    assert len(pick("li + li", all=True, page=wide)) == n
    assert time.perf_counter() - began < 120


def test_spark_struct(spark):
    df = spark.createDataFrame([(1, SHOP), (2, ""), (3, None), (4, "<div>" * 5000 + "<h2>deep")], "i int, html string")
    rule = Rule((("title", Field("h2")), ("ids", Field("li", "data-sku", all=True))))
    rows = df.select("i", html.extract(F.col("html"), rule).alias("x")).orderBy("i").collect()
    assert rows[0].x.title == "Green" and rows[0].x.ids == ["g1", "g2", "b7"] and rows[0].x.warnings == []
    assert rows[1].x.title is None and rows[2].x.ids is None and rows[3].x.title == "deep"
