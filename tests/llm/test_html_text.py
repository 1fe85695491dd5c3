import html
import re

from pairjudge.llm.html_text import extract, main_text

PAGE = """<html><head><title>T</title><style>x{}</style></head><body class="home has-sidebar"><header class="site"><a href=/>Home</a> Site name</header>
<nav>One Two</nav><div id="cookie-notice">We use cookies, ok? Yes. We do, indeed, use them.</div><div class="content"><h1>Real Title</h1>
<p>First para, with some text. And more, of course; it is long enough to count.</p>
<p>Second&nbsp;para &amp; more text, here it goes on and on. Really, it does.<br>line two</p><ul><li>point a</li><li>point <b>b</b></li></ul>
<div class="advert">Buy now! Cheap, good, fast. Buy it.</div><p>Last.</p></div><div class="sidebar">Side, side. Side.</div>
<section id="comments"><h2>Comments</h2><p>I like this, a lot. Great read, thanks for it!</p></section>
<form>Name <input name=x></form><footer>&copy; me, you. All.</footer><script>if (a<b) {"</p>"}</script></body></html>"""


def test_boilerplate_goes_and_the_article_stays():
    assert main_text(PAGE) == ("Real Title\nFirst para, with some text. And more, of course; it is long enough to count.\n"
                               "Second para & more text, here it goes on and on. Really, it does. line two\npoint a\npoint b\nLast.")


def test_article_pages_are_extracted_exactly(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in extract(pages).collect()}
    for page in pages.collect():
        inside = page.html[page.html.index("<article>") + 9:page.html.index("</article>")]
        parts = re.split(r"</?(?:h1|p)>", inside)
        lines = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", p))).split()) for p in parts)
        text = "\n".join(x for x in lines if x)
        assert (found[page.page_id].text, found[page.page_id].n_chars, found[page.page_id].url) == (text, len(text), page.url)


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<script>foo") == main_text("<!-- x") == ""
    assert main_text("just text, no tags. yes") == "just text, no tags. yes"
    assert main_text("<table><tr><td>a, b.<td>c, d.<tr><td>e. f,</table>") == "a, b.\nc, d.\ne. f,"
    assert main_text("<article><p>a &lt;b&gt; &#228;&am; x<p>y</article>") == "a <b> ä&am; x\ny"
    assert main_text("<article><p title='>'>a, b.<img alt=\"x>y\">c</p></article>") == "a, b.c"


def test_deep_and_long_pages():
    assert main_text("<div>" * 50_000 + "a, b. c" + "</div></p>" * 50_000) == "a, b. c"
    assert main_text("<article>" + "<p>a, b. " * 20_000 + "</article>").count("\n") == 19_999


def test_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 6), (2, "v", "", 7)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert [(r.page_id, r.n_chars > 0) for r in found.collect()] == [(1, True), (1, True), (None, False), (2, False)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = "".join(f"<p>Paragraph {i}, with some text of its own; it goes on, and on, for a while. And then it ends.</p>" for i in range(8))
LINES = "\n".join(f"Paragraph {i}, with some text of its own; it goes on, and on, for a while. And then it ends." for i in range(8))


def test_body_in_a_div_beside_a_teaser():
    assert main_text(f"<body><div class='story'><h1>Title</h1>{BODY}</div><article><p>Read this, too.</p></article></body>") == "Title\n" + LINES
    assert main_text(f"<body><div class='story'>{BODY}<article><p>Read this, too.</p></article></div></body>") == LINES


def test_lists_of_links_inside_an_article():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Some page {i}</a></li>" for i in range(6)) + "</ul><p><a href=t1>tag one</a> <a href=t2>tag two</a> <a href=t3>tag three</a></p>"
    assert main_text(f"<article><h1>Title</h1>{BODY}{links}</article>") == "Title\n" + LINES
    kept = "<p>A sentence with <a href=x>a link</a>, and one with <a href=y>another</a> or <a href=z>a third</a>, stays whole.</p>"
    assert main_text(f"<article>{BODY}{kept}</article>") == LINES + "\nA sentence with a link, and one with another or a third, stays whole."


def test_container_tags_renamed_to_div(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    same = [main_text(p.html.replace("<article>", "<div>").replace("</article>", "</div>").replace("<main", "<div").replace("</main", "</div")) == main_text(p.html) for p in pages]
    assert sum(same) >= 0.9 * len(same), (sum(same), len(same))
