import random

import pytest

from tributary.llm.html_text import Page, host_of, main_text, parse, templates

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>BODY</body></html>"


@pytest.mark.parametrize(("body", "text"), [
    ("<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><article><h1>Head</h1><p><b>One<br>two<p>Three &amp; &quot;four&quot;</p></article><footer>&copy; x</footer>", 'Head One two Three & "four"'),
    ("<header>Site</header><article><header><h1>Own</h1></header><p>Te<b>xt</b>\n\t here</p><footer>by me</footer></article>", "Own Text here"),
    ("<div class='ad'>Buy</div><div id=cookie-banner>Cookies</div><main><p>Main</p><form>Mail <input></form></main><aside>Side</aside>", "Main"),
    ("<article><p>A</p><section class='comments'><article><p>first!</p></article></section></article>", "A"),
    ("<article><p>1 &lt; 2 &#x27;q&#39; &nbsp; &am</p><!-- no --><pre>x  y</pre></article>", "1 < 2 'q' &am x y"),
    ("<article><p class=lead title='a > b'>Quoted</p><p>un\"closed <i>x</article>tail", 'Quoted un"closed x'),
    ("<div role=navigation>n</div><div hidden>h</div>plain <span>text</span>", "plain text"),
    ("<article></article>", ""), ("", ""), ("<p>never <article>opened", "never opened"[6:]), ("<article><p>open <script>x", "open"),
])
def test_main_part(body, text):
    assert Page.of(PAGE.replace("BODY", body)).text() == text


def test_no_recursion_and_linear():
    deep = "<div>" * 20000 + "deep" + "</div>" * 20000
    assert Page.of(deep).text() == "deep"
    assert len(parse("<p" * 20000)) == 1 and Page.of('<a "' * 5000).text()
    assert Page.of("x" * 1_000_000).text() == "x" * 1_000_000


def test_hosts():
    assert [host_of(u) for u in ("http://A.b/c", "https://u@h:8/x", "x", None, "http://e?x")] == ["a.b", "h", "", "", "e"]


def test_template_is_deleted_per_host(spark):
    page = "<body><div><p>Welcome to the site</p></div><section><p>story {i}</p></section><ul><li>terms</li></ul></body>"
    rows = [(i, f"http://a.x/{i}", page.replace("{i}", str(i))) for i in range(12)]
    rows += [(100 + i, f"http://b.x/{i}", page.replace("{i}", str(i))) for i in range(3)]
    article = "<article><h1>Same</h1><p>Licence line</p><div>Share this</div></article>"
    rows += [(200 + i, f"http://c.x/{i}", article.replace("Same", f"Title {i}")) for i in range(8)]
    docs = spark.createDataFrame([(*r, "other", "other") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r["page_id"]: r["text"] for r in main_text(docs).collect()}
    assert all(got[i] == f"story {i}" for i in range(12))
    assert all(got[100 + i] == f"Welcome to the site story {i} terms" for i in range(3))
    assert all(got[200 + i] == f"Title {i} Licence line" for i in range(8))
    assert templates(docs).filter("host = 'b.x'").count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://h/", ""), (2, "http://h/", "<article>x</article>"), (2, "http://h/", "<article>x</article>"), (3, "u", "é" * 3)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in main_text(docs).collect())
    assert got == [("1", "", 0), ("2", "x", 1), ("2", "x", 1), ("3", "ééé", 3), ("None", "", 0)]
    assert main_text(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("body", "text"), [
    ("<div class='content has-sidebar'><article><h1>Head</h1><p>Text</p></article></div><div class=sidebar>Side</div>", "Head Text"),
    ("<article><div class='comments-open'><p>A long story</p></div><div class=share>Share</div><p>End</p></article>", "A long story End"),
    ("<article><p>Intro</p><p class='social-policy'>A long text of a social policy</p></article>", "Intro A long text of a social policy"),
    ("<div id=nav-wrapper><main><p>Main text</p></main></div>", "Main text"),
    ("<div class='page menu-left'><p>Only text here</p></div><div class=menu>Home</div>", "Only text here"),
    ("<article><p>The story is longer</p></article><div class=related><article><p>Teaser</p></article></div>", "The story is longer"),
])
def test_names_do_not_remove_the_main_text(body, text):
    assert Page.of(PAGE.replace("BODY", body)).text() == text


def test_template_of_a_section_of_a_large_host(spark):
    rows = [(i, "http://h/", f"<div><ul><li>{'Section menu' if i < 60 else f'menu {i}'}</li></ul><p>story {i}</p></div>") for i in range(1200)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i}" if i < 60 else f"menu {i} story {i}" for i in range(1200)}


def test_prose_of_the_site_inside_articles(spark):
    """No name tells these apart: only that they stand under many titles of the host."""
    rng = random.Random(4)

    def words(n):
        return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(999)) for _ in range(n))

    rows, wanted = [], {}
    for host in ("a.x", "b.x"):
        for i in range(200):
            title, one, two = words(4), words(40), words(30)
            licence = "<p>Quoted under a free licence of 1999</p>" if i % 70 == 0 else ""
            advert = "<p class=k7>Try our reader for a month</p>" if i % 2 else ""
            reply = "<div><p>Log in to say what you think</p><div><p>Great piece!</p></div></div>"
            body = f"<p>From our desk in the harbour</p><h1>{title}</h1><p>{one}</p>{advert}<p>{two}</p>{licence}{reply}"
            rows.append((len(rows), f"http://{host}/{i}", f"<html><body><article>{body}</article></body></html>"))
            wanted[rows[-1][0]] = " ".join([title, one, two, "Quoted under a free licence of 1999"][: 4 if licence else 3])
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text(docs).collect()} == wanted


def test_copied_stories_stay(spark):
    """Copies on one host, some with words changed, are no template of it."""
    story = "<article><h1>{t}</h1><p>Short first words</p><p>{b}</p><p>The long rest of a story that many pages of the host hold again and again.</p></article>"
    rows = [(i, "http://h/", story.format(t="Same title" if i % 3 else f"Same title {i}", b=f"Body {i % 40}")) for i in range(300)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Short first words" in t and "long rest" in t for t in got.values()) and len(got) == 300


@pytest.mark.parametrize(("body", "text"), [
    ("<article><p>A long story</p><article class=r1><p>so so</p></article></article>", "A long story"),
    ("<article><p>A long story</p><section class='responses'><p>first!</p></section></article>", "A long story"),
    ("<main><article><p>A long story of the day</p></article></main><article class=k><p>Teaser</p></article>", "A long story of the day"),
    ("<article><p>One of two</p></article><article><p>Two of two</p></article>", "One of two Two of two"),
    ("<article><article><p>Wrapped twice</p></article></article>", "Wrapped twice"),
])
def test_articles_beside_and_inside(body, text):
    assert Page.of(PAGE.replace("BODY", body)).text() == text


def test_many_marks_are_linear():
    deep = Page.of("<div>x" * 5000 + "</div>" * 5000)
    pieces, marks = deep.parts()
    assert len(marks) == 5000 and len(pieces) <= 10001
    assert deep.text(frozenset(d for d, first, _ in marks if first)) == "x"
