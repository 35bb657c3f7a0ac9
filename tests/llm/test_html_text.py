from html.parser import HTMLParser

from lendmend.llm import html_text, queries

PAGES = "page_id long, url string, html string"


class Plain(HTMLParser):
    """Brute force for well-formed pages: text of block elements inside the article."""

    def __init__(self):
        super().__init__()
        self.lines, self.text, self.article, self.out = [], [], False, 0

    def end(self):
        if line := " ".join("".join(self.text).split()):
            self.lines.append(line)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "p", "article", "ul", "li", "form", "aside"):
            self.end()
        self.article |= tag == "article"
        self.out += tag in ("script", "style", "form", "aside")
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "p", "article", "ul", "li", "form", "aside"):
            self.end()
        self.article &= tag != "article"
        self.out -= tag in ("script", "style", "form", "aside")

    def handle_data(self, data):
        if self.article and not self.out:
            self.text.append(data)


def brute(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.lines)


ARTICLE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><article>';</script></head><body>"
    "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class='ad'>Buy this</div><article>"
    "<h1>Head &amp; more</h1><p>First  para\n with <b>bold</b>wo<i>rd</i> &lt;tag&gt; &#233;<br>next<p>Unclosed &nbsp; para</p>"
    "<ul><li>One</li><li>2</li></ul><form><p>Name</p></form><aside>See also</aside><script>x()</script><p>End.</p></article>"
    "<footer>&copy; site</footer></body></html>"
)


def test_article():
    assert html_text.main_text(ARTICLE) == "Head & more\nFirst para with boldword <tag> é next\nUnclosed para\nOne\n2\nEnd."
    assert html_text.main_text(ARTICLE) == brute(ARTICLE)


def test_all_test_pages_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = queries.op5_html_text(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_without_article():
    body = "".join(f"<p>{'Long text of the story goes on here. ' * 4}{i}</p>" for i in range(6))
    page = f"<body><div class='site-header'>Name</div><div><a>a</a></div><div id=content>{body}</div><div class='comments'><p>Nice!</p></div><div class='cookie-notice'>OK?</div></body>"
    got = html_text.main_text(page).split("\n")
    assert [x[-1] for x in got if x.startswith("Long")] == list("012345") and "Nice!" not in got and "OK?" not in got


def test_broken_markup():
    assert html_text.main_text("<article><p>a<div class=ad>never closed <p>b</article>") == "a\nnever closed\nb"
    assert html_text.main_text("<article><p>x < y <script>lost") == "x < y"
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<p>" * 20_000 + "deep") == "deep"
    assert html_text.main_text("<article><p title='a > b <c>'>x</p><p title=\"it's>y</p></article>") == "x\ny"
    for part in ("<a href='", '<p a="', "<div class=ad>", "<script>", "<"):  # in time proportional to the page
        html_text.main_text(part * 10_000)
    assert html_text.main_text("<!-- open") == "" == html_text.main_text("<article></article>")


def test_edge_rows(spark, saved):
    rows = [(1, None, None), (1, "u", ""), (None, "u", ARTICLE), (2, "u", ARTICLE), (2, "u", ARTICLE), (3, "u", "<p>" + "long " * 200_000)]
    got = queries.op5_html_text(spark, saved(pages=(rows, PAGES))).collect()
    assert len(got) == 6 and sorted(r.n_chars for r in got)[:2] == [0, 0]
    assert max(r.n_chars for r in got) == 999_999
    assert queries.op5_html_text(spark, saved(pages=([], PAGES))).count() == 0
    extra = spark.createDataFrame([(1, "<p>a", "old", 9)], "page_id long, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extract_text(extra).collect()] == [(1, "a", 1)]
