from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlsplit

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.html import links_of


def apply(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, u string")
    return [r[1] for r in df.select("i", f(F.col("u")).alias("o")).orderBy("i").collect()]


def test_canonical_cases(spark):
    cases = {
        "HTTPS://Shop.Example.NET:443/Tea": "https://shop.example.net/Tea",
        "http://tea.test:80?z=9&b=%20x&b=1": "http://tea.test/?b=+x&b=1&z=9",
        "https://ann:pw@tea.test/cup;v=2#handle": "https://tea.test/cup;v=2",
        "https://tea.test/cup/": "https://tea.test/cup/",
        "http://tea.test:8080/x?z=&y": "http://tea.test:8080/x?y=&z=",
        "https://tea.test/?q=*~ b": "https://tea.test/?q=%2A~+b",
        "http://tea.test:99999/": None,
        "http://tea.test:x/": None,
    }
    assert apply(spark, list(cases), urls.canonical) == list(cases.values())
    assert apply(spark, [None], urls.canonical) == [None]


WORD = st.text("abcXYZ019-._~*é ", min_size=0, max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["http", "HTTPS"]), st.sampled_from(["A.com", "b.co.uk:80", "c.org:8443"]), WORD, st.lists(st.tuples(WORD, WORD), max_size=4)), min_size=5, max_size=40))
def test_canonical_against_stdlib(spark, parts):
    made = [f"{s}://{h}/{p.replace(' ', '')}?{urlencode(q)}#f" for s, h, p, q in parts]

    def expected(u):
        p = urlsplit(u)
        port = p.port if p.port and {"http": 80, "https": 443}[p.scheme] != p.port else None
        q = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
        return f"{p.scheme}://{p.hostname}{f':{port}' if port else ''}{p.path or '/'}{'?' + q if q else ''}"

    got = apply(spark, made, urls.canonical)
    assert got == [expected(u) for u in made]
    assert apply(spark, got, urls.canonical) == got


def test_plain_urls_cost_one_match(spark):
    """A URL that is its own canonical form is cheap, one that has to be written anew isn't; both come out the same."""
    from time import perf_counter

    def seconds(end):
        rows = spark.range(200_000, numPartitions=4).select(F.concat(F.lit("https://shop.test/customer/"), F.col("id").cast("string"), F.lit(end)).alias("u"))
        took = []
        for _ in range(2):
            began = perf_counter()
            rows.agg(F.sum(F.hash(urls.canonical(F.col("u"))).cast("bigint")).alias("h")).collect()
            took.append(perf_counter() - began)
        return took[1]

    assert 3 * seconds("") < seconds("#x")
    plain = ["https://a.test/", "http://a-b.test/x;v=2/y", "https://a.test/@x/%7E~!*'()[]|\"<>^`{}\\", "https://a.test//x", "https://a.test/x:1/../y/"]
    close = {"https://a.test/x;": "https://a.test/x", "https://a.test/x\n": "https://a.test/x", "https://a.test/x?": "https://a.test/x", "https://a.test": "https://a.test/"}
    close |= {"https://A.test/x": "https://a.test/x", "https://a.test:443/x": "https://a.test/x", "https://u@a.test/x": "https://a.test/x", " https://a.test/x": "https://a.test/x"}
    respelled = [u.replace("https:", "HTTPS:").replace("http:", "HTTP:") for u in plain]
    assert apply(spark, [*plain, *respelled, *close], urls.canonical) == [*plain, *plain, *close.values()]


def test_rooted_links_are_joined_as_the_standard_library_does():
    bases = ["https://a.test", "https://a.test/x/y?q=1", "http://a.test/..", "HTTPS://A.test/x", "https://a.test:8080/x", "https://u@a.test/", "https://a.test?x", "", "/x"]
    hrefs = ["/", "/#top", "/a/b", "/a/b?", "/a?#f", "/a/", "/a//b", "//a/b", "/a/../b", "/./a", "/a/..", "/a?x=1", "/a;p", "/a b", "/a%20b", "/é", "/A-b_c~9", "/a#f#g"]
    for base in bases:
        expected = [urldefrag(urljoin(base, h))[0] for h in hrefs]
        assert links_of("".join(f'<a href="{h}">' for h in hrefs), base) == list(dict.fromkeys(x for x in expected if x.startswith(("http://", "https://"))))


def test_hosts_and_domains(spark):
    assert apply(spark, ["https://u@Foo.Co.UK:1/x", "nothing", ""], urls.host) == ["foo.co.uk", "", ""]
    assert apply(spark, ["foo.co.uk", "localhost", ""], urls.registrable) == ["co.uk", "localhost", ""]


def test_links():
    base = "http://tea.test/shop/green?p=1"
    hrefs = ["cup", "./a/../pot", "//cdn.test/k", "?p=2", "#top", "http://else.test/z#frag"]
    page = "".join(f"<p><a class=c href='{h}'>{i}</a>" for i, h in enumerate(hrefs))
    assert links_of(page, base) == [f"http://tea.test/shop/{x}" for x in ("cup", "pot")] + ["http://cdn.test/k"] + [f"http://tea.test/shop/green?p={n}" for n in (2, 1)] + ["http://else.test/z"]
    assert links_of("<base target=x><base href='/b/'><base href='/no/'><a href=c>", base) == ["http://tea.test/b/c"]
    skipped = ("JavaScript:go()", "mailto:t@tea.test", "tel:+1", "sms:1", "data:text/plain,x", "file:///x", "ftp://tea.test/")
    assert links_of("".join(f'<a href="{h}">' for h in (*skipped, "last")), base) == ["http://tea.test/shop/last"]
    assert links_of("<a href=one><a href='/shop/one'><a HREF=\"ONE\"><a name=q>", base) == ["http://tea.test/shop/one", "http://tea.test/shop/ONE"]
    assert links_of("<!-- <a href=x> --><style><a href=y></style><a title='>' href='/t?a=1&amp;b=2'>", base) == ["http://tea.test/t?a=1&b=2"]
    assert links_of("", base) == links_of(None, base) == []


def test_credentials_and_servers(spark):
    df = spark.createDataFrame([("socks5_http://user:p:w@x@h.io:80",)], "u string")
    r = df.select(urls.server_of(F.col("u")).alias("s"), urls.credentials(F.col("u")).alias("c"), urls.inferred_scheme(F.col("u")).alias("k")).first()
    assert (r.s, r.c.user, r.c.password, r.c.server, r.k) == ("socks5://h.io:80", "user", "p:w@x", "h.io:80", "socks5")


def test_typed_addresses_and_origins(spark):
    typed = {"example.com": "https://example.com", " https://a.com/x ": "https://a.com/x", "http://b.org": "http://b.org", "//c.net/y": "https://c.net/y", "": "", "ftp://d.com": "https://ftp://d.com", "/e.com": "https://e.com", "localhost:8000": "https://localhost:8000"}
    df = spark.createDataFrame(list(typed.items()), "raw string, want string")
    assert df.where(~urls.input_url(F.col("raw")).eqNullSafe(F.col("want"))).collect() == []
    home = "http://localhost:8000"
    targets = {"http://host:8000/a/b?c": "http://host:8000", "https://Host.example.com/": "https://host.example.com", "http://h:80/x": "http://h", "nonsense": home, "": home, "https://h:443": "https://h", home + "/": home}
    df = spark.createDataFrame(list(targets.items()), "raw string, want string")
    assert df.where(~urls.origin(F.col("raw")).eqNullSafe(F.col("want"))).collect() == []
