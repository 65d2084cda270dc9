"""The whole job: cases in which an operator once did a part of it."""

import textwrap

import numpy as np

from webloom.llm import decontaminate, html_text, licenses, media


def test_licenses_wrapped_lines():
    s = licenses.Scanner()
    found = lambda t: [x["license"] for x in s.scan(t)[1]]
    for name, wording in licenses.templates():
        for width, before in ((70, ""), (76, " * "), (40, "# ")):
            text = "\n".join(before + line for line in textwrap.wrap(wording, width))
            assert found(f"Some code\n\n{text}\n\nint main() {{ return 0; }}\n") == [name], (name, width)


def test_licenses_across_block_boundaries():
    s = licenses.Scanner()
    for shift in (0, 1, 300, 560, 599):
        text = "copyright " + "filler " * shift + "\n\n".join([licenses.BSD_3, licenses.GRANT_MIT, licenses.BSD_2] * 6)
        spans = s.scan(text)[1]
        assert [x["license"] for x in spans] == ["BSD-3-Clause", "MIT", "BSD-2-Clause"] * 6
        assert {text[x["start"] : x["end"]] for x in spans} == {t.rstrip(".") for t in (licenses.BSD_3, licenses.GRANT_MIT, licenses.BSD_2)}


def test_licenses_beyond_the_best_ranks():
    s = licenses.Scanner()
    found = lambda t: [x["license"] for x in s.scan(t)[1]]
    altered = licenses.BSD_3.replace("without", "with").replace("Neither", "Both")
    old = licenses.GRANT_ISC.replace("without fee", "no fee")
    assert found(altered) == [] and found(old) == []
    for name, notice in licenses.templates():
        if len(notice) < 120:
            assert found(f"{altered}\n{notice}") == [name] == found(f"{old}\n\n{notice}"), notice


def test_decontamination_does_not_depend_on_blocks(spark):
    word = lambda k: f"w{k}"
    items = [(k, " ".join(word(100 * k + i) for i in range(15))) for k in range(8)]
    filler = lambda n: " ".join(f"f{i}" for i in range(n))
    texts = [" ".join(t for _, t in items) + " " + filler(120 * n) for n in (1, 10, 19, 21)]  # 120 hit words, each item alone is under 1 in 20
    texts += [f"{items[k][1]} {filler(20)}" for k in range(4)] + [f"{items[0][1]} {filler(900)}", f"{filler(30)}, {items[5][1]}", None, ""]
    ids = [None, None, 7, 7, None, 7, 8, 9, None, 7, None, 7]
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), strict=True)), "doc_id bigint, text string, n int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    show = lambda df: sorted(map(repr, df.collect()))
    want = decontaminate.hits(docs, bench)
    assert want.count() == len(ids)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.n for r in kept.collect()} == {3, 8, 10, 11}
    for size in (150, 400):
        assert show(decontaminate.hits(docs, bench, size)) == show(want)
        several = decontaminate.drop_contaminated(docs, bench, size)
        assert several.schema == kept.schema and show(several) == show(kept)


def test_host_boilerplate_does_not_depend_on_host_size(spark, monkeypatch):
    words = lambda *x: " ".join("".join(f"{v}q" for v in (*x, i)) for i in range(12))
    menu, twice = "one menu of a section", "this stands on two pages"
    pages = [f"<div>{words(k, 1)}</div>" + f"<div>{menu}</div>" * (k in (3, 77, 120)) + f"<p>{twice}</p>" * (k in (5, 90)) for k in range(130)]
    rows = [(k, "http://big.com/x", p) for k, p in enumerate(pages)] + [(1000 + k, "http://small.com/", pages[k]) for k in (3, 77, 120, 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {k: words(k % 1000, 1) + f"\n\n{twice}" * (k in (5, 90, 1005)) for k, _, _ in rows}
    for size in (512, 8):
        monkeypatch.setattr(html_text, "SHARD_PAGES", size)
        assert {r.page_id: r.text for r in html_text.extract(df).collect()} == want


def test_unique_runs_decide_between_containers(spark, monkeypatch):
    """Of several articles on a page, those that stand on three pages of the host are left out beside a longer unique one."""
    words = lambda *x, n=12: " ".join("".join(f"{v}q" for v in (*x, i)) for i in range(n))
    article = lambda t: f"<article><h2>{t}</h2></article>"
    promo, rare, copied, quote = "come and see our new shop", "only two pages have this one", words("c", 1), "so said the wise old man"
    pages = {
        **{k: ([words(k, 1)], [promo]) for k in range(4)}, 4: ([words(4, 1), rare], [promo]), 5: ([words(5, 1), rare], []),
        **{k: ([copied, f"t{k}q"], []) for k in (6, 7, 8)},  # the longest stays though it is repeated
        **{k: ([words("d", 1), "copies of a page as a whole"], []) for k in (9, 10, 11)},
    }
    html = {k: "<nav>menu of the site here</nav><div>unmarked but outside</div>" + "".join(map(article, kept + out)) for k, (kept, out) in pages.items()}
    want = {k: "\n\n".join(kept) for k, (kept, _) in pages.items()}
    for k in (20, 21, 22):  # inside containers repeats stay
        html[k], want[k] = f"<article><p>{words(k, 1)}<p>{quote}</article>" + article(promo), f"{words(k, 1)}\n\n{quote}"
        html[k + 10], want[k + 10] = article(promo), promo  # a page's only one
    rows = [(k, f"http://{h}.com/", p) for h in ("a", "b") for k, p in html.items()]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (512, 2):
        monkeypatch.setattr(html_text, "SHARD_PAGES", size)
        assert {(r.page_id, r.url[7]): r.text for r in html_text.extract(df).collect()} == {(k, h): t for h in ("a", "b") for k, t in want.items()}


def test_html_marks_are_whole_names():
    text = lambda page: html_text.main_text(html_text.blocks_of(page))[0]
    for wrap in ("content-sidebar-wrap", "no-sidebar", "has-nav", "comments-open", "sidebar", "sidebar-right", "ad-free", "with_sidebar"):
        for key in ("class", "id"):
            assert text(f"<body><div {key}='{wrap}'><div><article><h1>A</h1><p>b c</article></div></div><div class='sidebar'><p>s</div>") == "A\n\nb c", wrap
            assert text(f"<body><div {key}='{wrap}'><main><p>b c</main></div>") == "b c", wrap
    inside = (
        "<article>{}<section id='legal-history'><h2 id='copyright'>B</h2><p>c</section><section id='search'><p>d</section><div id='search-results-analysis'><p>e</div>"
        "<p title='a hidden gem' data-class='ad'>f<p alt=\"class='ad' hidden\">g</article>"
    )
    assert text(inside.format("")) == "B\n\nc\n\nd\n\ne\n\nf\n\ng"
    dropped = ("class='ad'", "class='x ad-slot'", "id=main_nav", "class='related-posts'", "class=comments-area", "id='ad-1'", "role=navigation", "hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display: none'")
    for attrs in dropped:
        assert text(inside.format(f"<div {attrs}><p>z</div>")) == text(inside.format("")), attrs
    assert text("<article><p>a</article><div id='comments'><article class='comment-body'><p>n</article></div><div class='related-posts'><article><p>r</article></div>") == "a"


def test_fingerprint_hears_the_last_samples():
    rng = np.random.default_rng(5)
    for size in (576, 960, 1344):
        head = rng.integers(0, 256, size - 64, np.uint8).tobytes()
        offsets, times, codes = media.fingerprints([head + rng.integers(0, 256, 64, np.uint8).tobytes() for _ in range(20)])
        features = {(times[a:b].tobytes(), codes[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)}
        assert len(features) > 1, size


def test_html_of_hostile_pages_is_linear():
    import time

    n = 1 << 20
    fill = lambda part: part * (n // len(part))
    pages = [
        fill("</i>"), fill("<a "), fill("<![CDATA["), fill("<!-"), "<!--" + fill("x <p>"), fill("<div><a>"), fill("<b></p>"), fill("<svg/>"), fill("<a '>"),
        fill("<i>") + fill("<hr>"), "<i><div>" + fill("<b>") + fill("</i>"), "<ul>" + fill("<span>") + fill("<li>x"), fill("<td"), fill("<li>"), fill('<p title="'), fill("&amp"),
    ]
    for page in pages:
        began = time.perf_counter()
        html_text.main_text(html_text.blocks_of(page))
        assert time.perf_counter() - began < 30, page[:20]


def test_html_of_unclosed_parts():
    text = lambda page: [t for t, _, _ in html_text.blocks_of(page)]
    assert text("<p>a <![CDATA[b & c]]> d<p>e <!-- f <p>g") == ["a b & c d", "e"]
    assert text("<p>1 < 2 <b>x</b> <a href='q") == ["1 < 2 x <a href='q"]
    assert text("<p>a<svg/>b</p><p>c<svg><p>d</svg>e") == ["ab", "ce"]
    assert text("<ul><li>a<span>b<li>c</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["ab", "c", "1", "2", "3"]
