"""Main text of pages: what stays, what goes, and how hosts agree on a path."""

import pytest

from cairnmark.llm.html_text import Page, host_of, host_paths, main_text

LONG = "A long paragraph of plain prose that carries the meaning of the whole article and has no links in it at all, {} times over."


def text(source):
    return Page(source).text(None)


def article(body):
    return f"<html><body><div class='page'><article><p>{LONG.format('a')}</p>{body}<p>{LONG.format('b')}</p></article></div></body></html>"


@pytest.mark.parametrize(
    "noise",
    [
        "<nav><a href=/>Home</a></nav>", "<div class='menu'>Home About</div>", "<footer>Copyright</footer>", "<aside>More</aside>", "<div class='sidebar-left'>x y</div>", "<div id='cookie-notice'>We use cookies</div>",
        "<div class='ad'>Buy now</div>", "<form><label>Name</label><input></form>", "<script>var a='</p>';</script>", "<style>p{}</style>", "<section class='comments'><p>First reader comment</p></section>", "<!-- hidden -->",
        "<div hidden>gone</div>", "<div style='display: none'>gone</div>", "<div role=navigation>gone</div>", "<ul class='breadcrumbs'><li>Here</li></ul>", "<noscript>Enable it</noscript>", "<button>Press</button>",
    ],
)
def test_noise_goes(noise):
    assert text(article(noise)) == LONG.format("a") + "\n" + LONG.format("b")


def test_references_white_space_and_blocks():
    got = text(article("<p>Fish &amp; chips&nbsp;&#8211; caf&eacute;\n\t twice   over</p><h2>Head<b>line</b></h2><ul><li>one</li><li>two</li></ul>a<br>b"))
    assert got.split("\n")[1:-1] == ["Fish & chips – café twice over", "Headline", "one", "two", "a b"]


@pytest.mark.parametrize("source", ["", "   ", "<", "<div", "<p", "<!--", "<script>never ends", "</div></p>", "<p>&amp", "<a b='c", "<div>" * 3000, "\x00", "<html></html>", "<p>" + "x" * 1_000_000])
def test_broken_pages_do_not_fail(source):
    assert isinstance(text(source), str)


def test_hosts():
    assert [host_of(x) for x in (None, "", "nonsense", "HTTP://User:pw@WWW.Example.com:80/a?b", "https://a.b#c")] == ["", "", "", "www.example.com", "a.b"]


def test_votes_decide_the_path(spark):
    body = "<html><body><div class='teaser'><p>{}</p></div><div class='story12'><p>{}</p></div></body></html>"
    rows = [(i, f"http://news.example.org/{i}", body.format("Short teaser text of the page here.", LONG.format(i) * 3)) for i in range(9)]
    rows.append((9, "http://news.example.org/9", body.format(LONG.format("teaser") * 4, "The story is short today but it is still the story of the day.")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [(r.host, r.path.rsplit("/", 1)[1]) for r in host_paths(pages).collect()] == [("news.example.org", "div.story")]
    found = {r.page_id: r.text for r in main_text(pages).collect()}
    assert found[9].startswith("The story is short")


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, path string"
    rows = [(1, None, None, "x", "y"), (None, "http://a.b/", "", None, None), (1, "http://a.b/", article(""), "x", "y"), (1, "http://a.b/", article(""), "x", "y")]
    found = sorted(main_text(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.page_id is not None, r.n_chars))
    assert [(r.page_id, r.n_chars > 0, r.n_chars == len(r.text)) for r in found] == [(None, False, True), (1, False, True), (1, True, True), (1, True, True)]
    assert main_text(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("parts", [2, 3])
def test_articles_in_equal_parts_stay_whole(spark, parts):
    paragraphs = [LONG.format(f"{word} and again") for word in ("first", "second", "third")[:parts]]
    sections = "".join(f"<section class='part{i}'><p>{p}</p></section>" for i, p in enumerate(paragraphs))
    source = f"<html><body><div class='teaser'><p>Short teaser</p></div><article><h2>The heading of it</h2>{sections}</article></body></html>"
    assert len(Page(source).votes()) == len(dict(Page(source).votes()))
    pages = spark.createDataFrame([(i, "http://news.example.org/x", source) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in main_text(pages).collect()} == {"\n".join(["The heading of it", *paragraphs])}
    assert text(source) == "\n".join(["The heading of it", *paragraphs])


@pytest.mark.parametrize("part", ["<h2 id=related-work>Related work</h2>", "<p id=skip-lists>Skip lists are kept</p>", "<div class=social-history><p>Social history of it</p></div>", "<h3 class='header'>Header of a part</h3>", "<p class=notice>Mind the step</p>", "<section id='header-files'><p>Header files of C</p></section>"])
def test_parts_named_like_noise_stay(part):
    got = text(article(part)).split("\n")
    assert len(got) == 3 and got[1] in part


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "siteFooter", "cookie_notice", "main-nav", "ad", "ad-slot-3", "related-posts", "share-buttons", "comments-section"])
def test_containers_named_by_noise_words_go(name):
    assert text(article(f"<div class='x {name}'><p>gone</p></div>")) == text(article(""))


def test_rules_and_references():
    assert text(article("one<hr>two &<b>lt;</b> three<br/>four &amp;lt; five")).split("\n")[1:-1] == ["one", "two &lt; three four &lt; five"]


def test_sections_of_several_depths_stay_whole():
    six, two = (" ".join(LONG.format(i) for i in range(n)) for n in (6, 2))
    assert text(f"<body><div class=content><div class=sec>{six}</div><div class=sec>{two} SECOND</div></div></body>") == f"{six}\n{two} SECOND"
    wrapped = "".join(f"<div class=outer><div class=inner><p>{LONG.format(i)}</p></div></div>" for i in range(2))
    assert text(f"<body><article><h1>The title</h1>{wrapped}</article></body>").split("\n") == ["The title", LONG.format(0), LONG.format(1)]


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "deep", "<b>" * 200_000 + "bold", ("<div><p>" + LONG.format(1)) * 5000, "<ul><li>" * 50_000, "<div>" * 100_000 + "</b>" * 100_000])
def test_deep_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    assert isinstance(text(page), str) and isinstance(Page(page).votes(), list)
    assert time.process_time() - began < 20


def test_generated_pages_by_a_plain_extractor(spark, sf_dir):
    """The generated pages hold one article of headings, paragraphs and lists beside a menu, an advert and a footer."""
    import html
    import re

    import pyarrow.parquet as pq

    got = {r.page_id: r.text for r in main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    table = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    for page, source in zip(table["page_id"], table["html"], strict=True):
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        body = re.sub(r'<div class="ad">.*?</div>', "", body, flags=re.S)
        parts = re.split(r"</?(?:h1|p|ul|li|div)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body))
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert got[page] == "\n".join(x for x in want if x), page


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "comment-thread", "comment-body", "ad-300x250", "google-ads", "adsbygoogle", "navbar-expand-lg", "breadcrumb-trail", "hidden-xs"])
def test_noise_of_longer_names_goes(name):
    assert text(article(f"<div class='{name}'><p>{LONG.format('noise')}</p></div>")) == text(article(""))


@pytest.mark.parametrize("name", ["header", "banner", "page-header"])
def test_titles_in_parts_named_like_noise_stay(name):
    assert text(f"<body><article><div class='{name}'><h1>TITLE</h1></div><p>{LONG.format(1)}</p></article></body>") == f"TITLE\n{LONG.format(1)}"
    assert text(f"<body><div class='{name}'><h1>The site</h1></div><p>{LONG.format(1)}</p></body>") == LONG.format(1)


def test_a_name_or_a_form_does_not_hide_the_article():
    assert text(f"<main><div class=hidden-content><p>{LONG.format(1)}</p></div></main><div>zz</div>") == LONG.format(1)
    assert text(f"<body><form action=x><nav>Menu</nav><div class=content><p>{LONG.format(1)}</p></div><input></form></body>") == LONG.format(1)
    assert text(article(f"<form><p>{LONG.format('asked')}</p></form>")) == text(article(""))
    assert text(f"<body><article><p>Short story of the day.</p></article><section class=comments><p>{LONG.format('c') * 5}</p></section></body>") == "Short story of the day."


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "<p>x" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<li>" + "<b>" * n + "<li>x" * n, lambda n: "<h1><b>" * n + "<div>" * n + "</b>" * n, lambda n: "<div class=header>" * n + "x", lambda n: ("<div class=header><h1>t</h1>" + "</div>") * n])
def test_tags_left_open_take_time_in_proportion(make):
    import time

    took = []
    for n in (4000, 64_000):
        began = time.process_time()
        Page(make(n)).text(None)
        took.append(time.process_time() - began)
    assert took[1] < 64 * took[0] + 0.5 and took[0] < 0.5


def test_winners_that_are_not_broadcast(spark, monkeypatch):
    from cairnmark.llm import html_text

    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/", article(f"<p>{i}</p>")) for i in range(12)] + [(99, None, None)], "page_id long, url string, html string")
    want = sorted(tuple(r) for r in main_text(pages).select("page_id", "text").collect())
    monkeypatch.setattr(html_text, "SMALL", 0)
    assert sorted(tuple(r) for r in main_text(pages).select("page_id", "text").collect()) == want
