import pytest

from onsetframe.llm import style_tree as s

FRAME = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu"
    "</ul></nav><header>Site</header><div class='ad'>Buy</div>%s<aside>Side</aside><form><p>Your name</form>"
    "<div id='cookie-notice'>We use cookies</div><section class='comments'><article><p>First!</article></section><footer>&copy; x</footer></body></html>"
)


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Title</h1><p><b>One<br>line<br><p>Two &amp; &#233;&nbsp;three</p></article>", "Title\nOne line\nTwo & é three"),
    ("<main><header><h1>Head</h1></header>loose <i>text</i><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "Head\nloose text\na\nb\n1\n2"),
    ("<article>A<aside>no</aside><div class='share-buttons'>no</div><script>no</script><!-- no --><p hidden>no</p>B</article>", "A\nB"),
    ("<div class='content'><p>x &lt;y&gt; < z</p></div>", "x <y> < z"),
    ("<article><p>open <em>never closed", "open never closedYour name" * 0 + "open never closed"),
    ("<div role=main><p>a\n\t b</p><div role='navigation'>no</div></div>", "a b"),
    ("<article><p>a</b>b</p><pre> c\n d</pre><h2></h2></article>", "ab\nc d"),
    ("<article><p class='related-work'>kept</p><p id='comment-on-x'>too</p><div class='comments'>no</div><p id=comments>no</p>end</article>", "kept\ntoo\nend"),
    ("<article>A<script>x</script>B<nav>no</nav>C</article>", "AB\nC"),
    ("<article>A<div class=ad>no</div><b>B</b><form>no</form></article>", "A\nB"),
])
def test_templates(body, text):
    page = FRAME % body
    if "never closed" in body:
        page = "<nav>no</nav>" + body
    assert s.main_text(page) == text


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<!--", "<script>x", "</p></b>", "<article></article>", "<nav>only</nav>", "&#xffffffff;<>"])
def test_broken_pages(page):
    assert isinstance(s.main_text(page), str)


def site(i, host="h.example"):
    """Without telling names: boxes that all pages of a host share, and a text of the page's own."""
    return (
        i, f"https://{host}/{i}", f"<body><div class=x1><p>All the offers of the house</p><p>Call now</p></div><div class=x2><h1>Title {i}</h1>"
        f"<p>Own text of page {i}, told once.</p><p>Shared line.</p></div><div class=x3>Printed in the year {i % 2}</div></body>",
    )


def test_shared_branches_go(spark):
    pages = spark.createDataFrame([(*site(i), "x", 1, "h") for i in range(40)] + [(*site(99, "small.example"), "x", 1, "h")], "page_id long, url string, html string, text string, low int, host string")
    out = {r.page_id: r for r in s.extract_pages(pages).collect()}
    for i in range(40):
        assert out[i].text == f"Title {i}\nOwn text of page {i}, told once.\nShared line."
        assert out[i].n_chars == len(out[i].text) and out[i].low == 1 and out[i].host == "h"
    assert out[99].text.startswith("All the offers")  # a host of one page has no entropy


def test_importance_is_entropy(spark):
    pages = spark.createDataFrame([site(i) for i in range(16)], "page_id long, url string, html string")
    of = {r.node: r.importance for r in s.importance(pages).collect()}
    body = s.step(0, s.make("body", ""))
    value = lambda name: of[s.step(body, s.make("div", f" class={name}")) << 1]
    assert value("x1") == pytest.approx(0)
    assert value("x3") == pytest.approx(1 - 3 / 4)  # two texts on eight pages each: log 8 / log 16
    assert value("x2") == pytest.approx(2 / 3)  # two of three texts occur once, one everywhere


def article(i):
    """Junk under neutral names inside the main element."""
    return (
        i, f"https://h.example/{i}", f"<body><main><h1>Abstract</h1><div class=k7><p>Read our offers</p><p>Call now</p></div><div class=k8><p>Own text of page {i}.</p>"
        f"<p>Shared line.</p></div><div class=k9>Only on some pages</div></main><div class=k9>Printed {i % 2}</div></body>" if i % 3 else
        f"<body><main><h1>Abstract</h1><div class=k7><p>Read our offers</p><p>Call now</p></div><div class=k8><p>Own text of page {i}.</p></div></main></body>",
    )


def test_junk_inside_main_goes(spark, monkeypatch):
    rows = [article(i) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in s.extract_pages(pages).collect()}
    for i in range(40):
        assert out[i].splitlines()[:2] == ["Abstract", f"Own text of page {i}."] and "offers" not in out[i] and "Call" not in out[i]
        assert ("Shared line." in out[i]) == (i % 3 > 0)  # one text of many under its node
    monkeypatch.setattr(s, "SENT_NODES", 0)  # nodes and pages meet by salt
    assert {r.page_id: r.text for r in s.extract_pages(pages).collect()} == out


def test_copies_of_an_article_are_no_junk(spark):
    """Half of a host's pages are copies of one article with names of its own."""
    copy = "<body><main><h1>Title</h1><div class=special><p>A text that many pages copy.</p></div></main></body>"
    rows = [article(i) for i in range(20)] + [(100 + i, "https://h.example/c", copy) for i in range(30)]
    out = {r.page_id: r.text for r in s.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {out[100 + i] for i in range(30)} == {"Title\nA text that many pages copy."}
    assert all("offers" not in out[i] for i in range(20))


@pytest.mark.parametrize("open_, close", [("<div>", "</div>"), ("<b>", "</b>"), ("<div>", ""), ("<div><p>x", ""), ("<article><i>", "</u>"), ("<ul><li>", "</em>")])
def test_deep_markup(spark, open_, close):
    page = "<main>" + open_ * 100_000 + "deep" + close * 100_000 + "</main> after"
    pages = spark.createDataFrame([(i, "http://h/", page) for i in range(2)], "page_id long, url string, html string")
    assert all(r.text.endswith("deep") and r.n_chars == len(r.text) for r in s.extract_pages(pages).collect())


def test_an_article_is_never_judged_by_repetition(spark):
    page = "<article><p>The same article</p></article>"
    pages = spark.createDataFrame([(i, "http://h/", page) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in s.extract_pages(pages).collect()} == {"The same article"}
    plain = "<body><div><p>The same words</p></div></body>"
    pages = spark.createDataFrame([(i, "http://h/", plain) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in s.extract_pages(pages).collect()} == {"The same words"}  # nothing else is left


def test_edges(spark):
    rows = [(1, None, "<p>a"), (None, "http://h/x", None), (2, "not a url", ""), (3, "HTTP://User@H:80/x", "<p>b" + " c" * 200_000), (1, None, "<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text[:3]) for r in s.extract_pages(pages).collect()) == [(0, ""), (1, "a"), (1, "a"), (2, ""), (3, "b c")]
    assert [r["__host"] for r in s.with_host(pages).where("page_id = 3").collect()] == ["h"]
    assert s.extract_pages(pages.limit(0)).count() == 0


def test_given_pages(spark):
    out = s.op9_site_style_tree(spark, "/root/testdata/sf0.01")
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    for r in out.join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert r.text == s.main_text(article) and r.text
