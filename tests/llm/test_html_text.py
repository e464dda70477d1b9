import html
import re

import numpy as np
from pyspark.sql import functions as F

from fraudlens.llm import html_text as H
from tests.llm.util import SF


def text(page):
    return "\n".join(H.decide(H.blocks(page))[0])


def brute(page):
    """The fixture's template by plain patterns: the one article, cut at tags."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", m[1])) if m else []
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_whole_table_matches_brute_force(spark):
    from fraudlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op1_html_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_regions_that_go():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>"</p><article>no</article>"</script></head>
    <body class="has-sidebar nav-open"><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
    <div id="sidebar">Side</div><aside>More</aside><main><article class="post"><header><h1>Title &amp; more</h1></header>
    <p>First&nbsp;para <b>bold</b>,<br>line</p><!-- c --><div class="ad">Buy</div><p>Second <a href="x>y">link</a> 1 < 2 &lt;b&gt;
    <ul><li>one<li>two</ul><form><label>Mail</label><input></form><table><tr><td>a<td>b</table><section class="comments"><article>Nice!</article></section>
    <p hidden>secret</p><span style="display:none">x</span><p class="share-buttons">Share<p>Last</article><div class="related">See also</div></main>
    <footer>&copy; X</footer><form>Login</form></body></html>"""
    assert text(page) == "Title & more\nFirst para bold, line\nSecond link 1 < 2 <b>\none\ntwo\na\nb\nLast"


def test_broken_markup_and_odd_pages():
    assert text(None) == text("") == text("<nav>only") == text("<!-- open") == ""
    assert text("<article>a</b></i></div>b<p>c") == "ab\nc" or text("<article>a</b></i></div>b<p>c") == "a\nb\nc"
    assert text("<article><p>x<script>never closed <p>y") == "x"
    assert text("<ARTICLE><P>Up &eacute;&#233;&#x00e9; &unknown; AT&T</P></ARTICLE>") == "Up ééé &unknown; AT&T"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<main><p>in main</p></main><p>out") == "in main"
    assert text("<div class='entry-content'><p>post</p></div><p>out") == "post"
    assert text("<article><p title='<p>'>q</p><p a=\"b>c</p>") in ("q", "q\nc")
    assert H.decide(H.blocks("plain text <b>only</b>")) == ([], ["plain text only"])


def page_of(i, article):
    return f"<div><p>Home News Sport Weather Travel Food Style Video Contact page</p></div><div><p>{article}</p></div><div>All rights reserved by the example company of nowhere at all in 2024</div>"


ARTICLES = [" ".join(f"w{(i * 7919 + j * j * 31 + j) % 100003}x{i}" for j in range(40)) for i in range(12)]


def test_repetition_on_a_host_decides_pages_without_regions(spark):
    rows = [(i, "http://one.example/p", page_of(i, a)) for i, a in enumerate(ARTICLES)]
    rows += [(100, "http://two.example/p", page_of(100, ARTICLES[0]))]  # another host: nothing repeats there
    rows += [(200 + i, "http://copy.example/p", page_of(0, ARTICLES[0])) for i in range(9)]  # the same page is no repetition
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("row", "id", "host", "parts", "h", "text")})
    for chunk in (500_000, 100):  # a host in one chunk, and in many
        got = {r.page_id: r.text for r in H.main_text(df, chunk_tokens=chunk).collect()}
        assert all(got[i] == a for i, a in enumerate(ARTICLES))
        assert ARTICLES[0] in got[100] and "Home News" in got[100]
        assert all("Home News" in got[200 + i] for i in range(9))


def test_odd_rows_and_empty_table(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "not a url", "text without any tag"), (3, "http://h/", "<article>" + "long " * 100000), (3, "http://h/", "&amp;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.text[:30], r.n_chars) for r in H.html_query(df).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, None, "", 0), (1, None, "", 0), (2, "not a url", "text without any tag", 20),
                          (3, "http://h/", ("long " * 10)[:30], 499999), (3, "http://h/", "&", 1)], key=str)
    assert H.html_query(df.limit(0)).count() == 0


def test_suffix_array_counts_pages_of_shared_runs():
    a, b, c = (np.array(x, dtype=np.uint64) for x in ([1, 2, 3, 4, 9, 1, 2, 3], [7, 1, 2, 3, 4], [5, 6]))
    h, n = H.shared_prefixes([a, b, c], 3)
    want = {}
    for i, p in enumerate((a, b, c)):
        for w in H.windows(p, 3).tolist():
            want.setdefault(w, set()).add(i)
    assert dict(zip(h.tolist(), n.tolist())) == {w: len(s) for w, s in want.items()}


def test_wrappers_do_not_take_their_article_with_them():
    for page, want in (
            ('<div class="layout no-sidebar"><article><p>Body text.</p></article></div><div>x</div>', ["Body text."]),
            ('<div class="page has-menu"><main><p>Body</p></main></div>', ["Body"]),
            ('<article><p>a</p><section class="related-work"><p>chapter</p></section><div class="related-posts">no</div></article>', ["a", "chapter"]),
            ('<article><p>Body</p></article><article class="teaser"><p>t</p></article>', ["Body"]),
            ('<div class="menu"><article><p>The only article text here.</p></article></div><p>x</p>', ["The only article text here."])):
        assert H.decide(H.blocks(page)) == (want, [])
    teasers = '<div class="sidebar"><article>card</article></div><p>Real long text of the page stands here.</p>'
    assert H.decide(H.blocks(teasers)) == ([], ["Real long text of the page stands here."])


def test_repetition_decides_what_lies_outside_an_article(spark):
    footer = "All rights reserved by the example company of nowhere at all in 2024"
    quote = "a passage that every article of this host quotes in the same nine words"
    lead = [" ".join(f"lead{i}x{j}" for j in range(12)) for i in range(4)]

    def page(i):
        return f"<p>{lead[i]}</p><article><p>{ARTICLES[i]}</p><p>{quote}</p></article><p>by someone</p><div>{footer}</div>"

    rows = [(i, "http://one.example/p", page(i)) for i in range(4)] + [(9, "http://one.example/q", f"<div>{ARTICLES[9]}</div><div>{footer}</div>")]
    rows += [(10 + i, "http://two.example/p", page(i)) for i in range(2)]  # too few pages for a verdict
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = H.ASKED_TOKENS
    try:
        for chunk, some in ((500_000, before), (40, before), (40, 0)):
            H.ASKED_TOKENS = some
            got = {r.page_id: r.text for r in H.main_text(df, chunk_tokens=chunk).collect()}
            assert all(got[i] == f"{lead[i]}\n{ARTICLES[i]}\n{quote}" for i in range(4))
            assert got[9] == ARTICLES[9]
            assert all(got[10 + i] == f"{ARTICLES[i]}\n{quote}" for i in range(2))
    finally:
        H.ASKED_TOKENS = before
    assert H.decide(H.blocks(page(0))) == ([ARTICLES[0], quote], [lead[0], footer])
