import html
import random
import re

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import html_extract
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_common_subsequence_is_longest():
    draw = random.Random(1)
    for _ in range(800):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = html_extract.common(np.array(a, np.int64), np.array(b, np.int64))
        rest = iter(b)
        assert len(at) == best[-1][-1] and all(a[i] in rest for i in at)


def test_query_gives_articles(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    rows = QUERIES["op2_html_extraction"](spark, SF).toPandas().set_index("page_id")
    assert len(rows) == len(pages)
    for key, page in zip(pages.page_id, pages.html):
        body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
        body = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", body))
        want = re.sub(r"\s+", " ", html.unescape(body)).strip()
        assert rows.loc[key].text == want and rows.loc[key].n_chars == len(want)


def page(text, extra=""):
    return f"<html><body><div class='top'>Site name</div><p>Home | News</p><div>{text}</div><p>All rights reserved 2024</p>{extra}</body></html>"


def test_template_of_a_host_is_deleted_where_no_element_names_the_article(spark):
    own = "<p>Second own <b>bo</b>ld\n text</p>"
    rows = [
        (1, "http://a.org/x/1", page("<p>First own text &amp; more</p>")), (2, "http://a.org/x/2", page(own)), (3, "http://www.a.org/x/2#top", page(own)),
        (4, "http://other.org/x/3", page("<p>alone</p>")), (5, "http://c.org/", "same"), (6, "http://c.org/1", "same"), (7, None, None), (8, "", ""), (7, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as lines", "3 as content")
    got = html_extract.extract_pages(frame).toPandas()
    text = dict(zip(got.page_id, got.text))
    assert len(got) == 9 and text[1] == "First own text & more" and text[2] == text[3] == "Second own bold text"
    assert text[4] == "Site name Home | News alone All rights reserved 2024" and text[5] == text[6] == "same" and text[7] == text[8] == ""
    assert html_extract.extract_pages(frame.filter("false")).count() == 0


def lines(source):
    return [t for t, _ in html_extract.page_lines(source)]


def test_parts_outside_the_article():
    source = """<body><header>H</header><nav><ul><li>x</li></ul></nav><div id="cookie-notice">c</div><main><h1>T</h1><p>one<p>two &lt;b&gt;<div class="ad-slot">buy</div>
        <form>f <p>g</p></form><script>var a="<p>";</script><!-- <p>no</p> --><section class="comments"><p>said</p></section><blockquote>q</blockquote></main>
        <aside>s</aside><div class=sidebar>t</div><footer>F</footer></body>"""
    assert lines(source) == ["T", "one", "two <b>", "q"]


def test_comments_as_articles_and_named_parts():
    source = """<body class="has-sidebar"><div id="site-header">H</div><article class="post"><header>by</header><p>own</p></article>
        <section class="comments"><article class="comment"><p>one</p></article><article><p>two</p></article></section><article class="comment">three</article></body>"""
    assert lines(source) == ["by", "own"]
    assert lines("<nav>x<main><p>kept</p></main><nav>y</nav>") == ["kept"]


def test_broken_markup():
    assert lines("<div class='ad'>never closed<article><p>kept</article>") == ["kept"]
    assert lines("<p><b>bold<p>next<br>more<table><tr><td>a<td>b</table>") == ["bold", "next", "more", "a", "b"]
    assert lines("plain &am text <a href='x>y'>z</a") == ["plain &am text z"]
    assert lines("<p>x<") == ["x<"] and lines("") == [] and lines("<style>p{}") == []
    assert lines("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]
    assert len(lines("<div>" * 5000 + "deep" + "</div>" * 5000)) == 1
    assert lines("<p>" + "word " * 50_000)[0].startswith("word word")


def test_mirrored_articles_stay():
    own = [html_extract._hash(t) for t in ("a", "b")]
    assert html_extract.kept_lines(["a", "b"], [True, True], np.array(own), [np.array(own)]) == ["a", "b"]
    assert html_extract.kept_lines(["a", "b"], [False, False], np.array(own), [np.array([own[0], 5])]) == ["b"]


def articled(i):
    return f"<body><article><h1>Title {i}</h1><p>Share this page</p><p>{'A quoted passage' if 3 <= i <= 5 else f'Lone {i}'}</p><p>Own text {i}</p></article><div>Read more</div><div>Lede {i}</div></body>"


def test_pages_with_articles_are_differenced(spark):
    rows = [(i, f"http://a.org/{i}", articled(i)) for i in range(1, 10)] + [(20, "http://b.org/", articled(20))]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # on every page of the host, inside the article too: template; shared by both neighbours of page 4 but on three of nine pages: own text
    assert got[4] == "Title 4 A quoted passage Own text 4 Lede 4" and got[2] == "Title 2 Lone 2 Own text 2 Lede 2"
    assert got[20] == "Title 20 Share this page Lone 20 Own text 20"  # no neighbour: markup alone


def test_elements_without_an_end_tag_take_no_more_than_their_block():
    assert lines("<p>one <svg class='i' viewBox='0 0 1 1'/> two</p><p>three</p>") == ["one two", "three"]
    assert lines("<p>a<title-bar x=1>b</title-bar></p><object-view>c</object-view><p>d</p>") == ["ab", "c", "d"]
    assert lines("<div><svg><title>icon</title><path d=''></div><p>kept</p>") == ["kept"]
    assert lines("<div><select><option>x<option>y</div><p>kept</p><div><template><p>no</p></div><object>o<p>q</p></object><canvas>c</canvas><p>more</p>") == ["kept", "more"]
    assert lines("<p>on<svg><path/></svg>ly <canvas>x</canvas>one line</p>") == ["only one line"]


def test_a_page_between_stubs_meets_the_next_different_page(spark):
    top, foot = "<div>Site name</div><p>Home | News</p>", "<p>All rights reserved</p>"
    texts = [(1, "<p>Own one</p>"), (2, None), (3, ""), (4, "<p>Own four</p>"), (5, ""), (6, None), (7, "<p>Own seven</p>")]
    # pages 2, 3, 5 and 6 hold only template lines, in four different ways
    stubs = {2: top, 3: foot, 5: "<div>Site name</div>" + foot, 6: "<p>Home | News</p>"}
    rows = [(i, f"http://a.org/{i}", f"<body>{stubs[i]}</body>" if i in stubs else f"<body>{top}{t}{foot}</body>") for i, t in texts]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Own one" and got[4] == "Own four" and got[7] == "Own seven"


def test_names_alone_drop_nothing_inside_an_article(spark):
    kept = """<h2 id="related-work">Related work</h2><h2 class="search-title" id="search-algorithms">Search</h2><section id="discussion"><p>We discuss.</p></section>
        <p class="notice-of-intent">Notice of intent.</p><div class="social-history"><p>Social history.</p><blockquote class="reply">A reply</blockquote></div>"""
    gone = """<div class="related-posts"><a href=1>one</a> <a href=2>two</a></div><ul class="share"><li>Share</li></ul><div class="newsletter-box"><p>Mail <input name=m></p></div>
        <div class="comment-list"><div class="comment-item"><p>said</p></div></div><div class="promo-unit">Buy now</div><div hidden><p>x</p></div>"""
    want = ["T", "Related work", "Search", "We discuss.", "Notice of intent.", "Social history.", "A reply", "end"]
    assert lines(f"<article><h1>T</h1>{kept}{gone}<p>end</p></article>") == want
    # a host whose template stands inside the article, in named parts of running text; the article's own lines are quoted by a neighbour
    body = lambda i: f"<article><h1>Title {i}</h1><p>Own text {i}</p><div class='promo-text'><p>Buy our book today</p></div><p>Quoted line</p></article>"
    rows = [(i, f"http://t.org/{i}", body(i)) for i in range(5)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert all("Buy our book" not in t and f"Own text {i}" in t for i, t in texts.items())


def test_long_pages_align_by_matches(monkeypatch):
    draw = random.Random(2)
    for top in (3, 40, 4000):
        a, b = (np.array([draw.randint(0, top) for _ in range(300)], np.int64) for _ in range(2))
        monkeypatch.setattr(html_extract, "PAIRED", 1 << 60)
        want = html_extract.common(a, b)
        monkeypatch.setattr(html_extract, "PAIRED", 0)
        got = html_extract.common(a, b)
        rest = iter(b.tolist())
        assert len(got) == len(want) and all(x in rest for x in a[got].tolist())
    import time

    lines = np.arange(200_000)
    start = time.time()
    assert len(html_extract.common(lines, np.random.default_rng(0).permutation(lines))) > 500 and time.time() - start < 20
