import re
from html import unescape

from terrahac.llm import queries, site_tree
from terrahac.llm.site_tree import main_text, parse

SF = "/root/testdata/sf0.01"


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op10_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        html = pages[r.page_id].html
        article = re.search("<article>(.*?)</article>", html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def text(html):
    return main_text(parse(html), {})


def test_markup():
    assert text("<body><header>Site</header><main><article><header><h1>A &amp; B</h1></header><p>One<b>two</b> three<br>four&nbsp;five<p>Six</article><section class='comments'><article>no</article></section></main><aside>x</aside><footer>f</footer>") == "A & B Onetwo three four five Six"
    assert text("<article><p>a</p><div class='ad-slot'><p>buy</p></div><form><input>go</form><span class=share>s <span>t</span> u</span>b</article>") == "a b"
    assert text("<p>plain <!-- no > --> text<script>if (a<b) '</p>'</script> here") == "plain text here"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == "a b c d e f g"
    assert text("<div id=\"comments\">x</div><div class='cookieNotice'>y</div>z 1 < 2 <3") == "z 1 < 2 <3"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end") == "deep end"
    assert text("") == "" and text("<nav>a") == ""
    assert text("<p title='it''s \"' >odd <a href=\"x>y</a> quotes") != ""



def test_class_words_alone_take_no_article():
    assert text('<article class="post comments-open"><p>a</p></article>') == "a"
    assert text('<div class="site no-sidebar"><div class="has-sidebar"><p>The text of the page</p></div><div class="sidebar">x</div></div>') == "The text of the page"
    assert text('<div id="page" class="has-sidebar"><article>one<div class="share">s</div></article><section class="comments"><article>a reply that is longer than all</article></section></div><nav>n</nav>') == "one"
    assert text("<div class='related'><article>teaser</article></div><div>A text that is longer</div>") == "A text that is longer"
    assert text("<div><div class='has-sidebar'><article>text</article></div><div class='sidebar'>much more in a list of links</div></div>") == "text"
    assert text("<p data-id='ad' data-class=menu title='a class=menu b'>kept</p><div class=menu>m</div>") == "kept"


def test_unclosed_elements_end_no_page():
    for tag in ("video", "object", "canvas", "svg", "math", "iframe", "audio", "noscript", "template", "select"):
        assert text(f"<p>a</p><{tag} id=x><p>b</p><{tag}><p>c") == "a b c"
    assert text("<p>a</p><script>b<p>c") == "a" and text("<p>a</p><svg><text>x</text></svg><video>y</video>b") == "a b"


def test_main_keeps_its_own_text_and_formulas():
    assert text("<main><h1>Title</h1><p>Lead</p><article>Story</article><nav>n</nav></main><p>out</p>") == "Title Lead Story"
    assert text("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> then</p>") == "if x=2 then"


def test_style_tree(spark):
    page = lambda body, i: (f"<div class='top'><p>Welcome to our site</p><p>Call us</p></div><div class='body'>{body}</div><div class='end'><p>All rights reserved</p></div>", f"http://Host.example/{i}")
    rows = [(i, *page(f"<p>Story number {i}</p><p>More of {i}</p>", i)[::-1]) for i in range(30)]
    rows += [(100 + i, f"https://u@other.example:80/{i}", f"<article><p>Shared article</p></article><p>{i}</p>") for i in range(40)]
    rows += [(200 + i, f"http://news/{i}", f"<article><p>Story {i}</p><div><p>Read our terms</p></div></article>") for i in range(30)]
    rows += [(300, None, None), (301, "x", ""), (302, "http://alone/", "<p>Only page</p>"), (302, "http://alone/", "<p>Only page</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'q' as text")
    got = {}
    for r in site_tree.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Story number 3 More of 3"]
    assert got[205] == ["Story 5"]
    assert got[105] == ["Shared article"]
    assert got[300] == got[301] == [""] and got[302] == ["Only page"] * 2
    salted = site_tree.extract(df, send_bytes=-1, salts=3)
    assert sorted((r.page_id, r.text) for r in salted.collect()) == sorted((i, t) for i, ts in got.items() for t in ts)
    assert site_tree.extract(df.limit(0)).count() == 0


def test_importance_of_a_host(spark):
    rows = [(i, "http://a/", f"<div><p>same</p></div><section><p>{i}</p></section>") for i in range(10)]
    low = site_tree.unimportant(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(low) == 1 and low[0].host == "a" and len(low[0].nodes) == len(low[0].importances) > 0


def test_attributes_of_any_length():
    for n in (10, 9_000, 300_000):
        for q in "\"'":
            assert text(f"<p data-x={q}{'y' * n}a > b{q}>hello</p>") == "hello"
            assert text(f"<p data-x = {q}{'y' * n}a > b{q} class=z>hello</p>") == "hello"
    assert text('<p title="never closed>a</p><p>b</p>') == "a b" and text("<p title=it's>a</p>") == "a"
    for page in ('<a "' * 100_000, "<a " * 100_000, "<a x='" * 100_001, "<a x=\"'" * 100_001):
        text(page)
    assert text("<article>" + "<p>word " * 200_000 + "</article>").count("word") == 200_000


def test_class_words_within_articles_need_more():
    assert text('<article><p class="notice">a</p><div class="share-price">b</div><section class="menu-of-the-day">c</section><h2 class="related">d</h2><div class="ad-slot">x</div><div class="share-buttons">y</div></article>') == "a b c d"
