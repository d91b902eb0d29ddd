import math
import random
import time

import pytest

from kinlink.llm import html_text as H
from kinlink.llm.html_text import extract, main_text

ARTICLE = "<article><h1>Title here</h1><p>First paragraph with enough words to count as text, really.</p><p>Second &amp; last\n\n paragraph&hellip; with   white space<br>inside.</p></article>"
TEXT = "Title here\n\nFirst paragraph with enough words to count as text, really.\n\nSecond & last paragraph… with white space inside."


@pytest.mark.parametrize(
    "page",
    [
        ARTICLE,
        f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>{ARTICLE}<footer>&copy; site</footer></body></html>",
        f"<body><header>Site <a href='/'>name</a></header>{ARTICLE}<aside>More things to read today</aside><script>var x='</p>';</script></body>",
        f"<body><div class='ad'>Buy this thing now, it is cheap and very good for you.</div>{ARTICLE}<div id=comments><article class=comment><p>I disagree with all of this, and here is a long reply of mine.</p></article></div></body>",
        f"<div class='cookie-notice'>We use cookies</div><form><p>Subscribe to us</p><input></form>{ARTICLE}<!-- a <p>comment</p> -->",
        f"<div class='page has-sidebar'><div class='sidebar'><ul><li><a>One</a></li></ul></div>{ARTICLE}</div>",
        ARTICLE.replace("<article>", "<main>").replace("</article>", "</main>"),
        ARTICLE.replace("</p>", ""),
        ARTICLE.upper().replace("TITLE HERE", "Title here").replace("FIRST PARAGRAPH WITH ENOUGH WORDS TO COUNT AS TEXT, REALLY.", "First paragraph with enough words to count as text, really.").replace("SECOND &AMP; LAST\n\n PARAGRAPH&HELLIP; WITH   WHITE SPACE", "Second &amp; last\n\n paragraph&hellip; with   white space").replace("INSIDE.", "inside."),
    ],
)
def test_article_is_found(page):
    assert main_text(page) == TEXT


def test_density_finds_the_body_without_an_article_element():
    words = "Some running text of a paragraph that goes on for a while. " * 4
    page = "<body><div><ul>" + "<li><a href=x>Link name</a></li>" * 12 + f"</ul></div><div id=c><p>{words}</p><p>{words}</p><p>{words}</p></div><div><a>imprint</a> <a>contact</a></div></body>"
    assert main_text(page) == "\n\n".join([words.strip()] * 3)


def test_sections_of_one_article_stay_together():
    words = "Some running text of a paragraph that goes on for a while. " * 3
    page = f"<body><div class=x><div><p>{words}</p></div><div><p>{words}</p><p>{words}</p></div></div></body>"
    assert main_text(page).count("\n\n") == 2


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></div>", "<script>", "<!-- ", "<![CDATA[x", "<a" * 2000, "<div>" * 5000])
def test_broken_pages_do_not_crash(page):
    assert isinstance(main_text(page), str)


def test_references_are_decoded_once():
    assert main_text("<article><p>&amp;lt;b&amp;gt; &#x41;&#66;&nbsp;c</p></article>") == "&lt;b&gt; AB c"


def test_long_page(spark):
    page = "<article>" + "<p>word word word</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, text long")
    got = {r["page_id"]: r for r in extract(df).collect()}
    assert got[1]["n_chars"] == 50_000 * 14 + 49_999 * 2
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0
    assert extract(df).count() == 3 and extract(df.limit(0)).count() == 0


def brute(node):
    """(C, T, LC, LT) by the definition, node for node."""
    c, t, lc, lt = 0, 0, 0, 0
    for y in node.items:
        if isinstance(y, str):
            c += len(y.strip())
        elif not y.dropped:
            a = brute(y)
            c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (y.tag == "a")
    return (c, t, c if node.tag == "a" else lc, lt)


def below(node):
    yield node
    for y in node.items:
        if not isinstance(y, str) and not y.dropped:
            yield from below(y)


def random_page(rng, depth=0):
    tag = rng.choice(("div", "section", "p", "ul", "span", "a", "b", "table"))
    inner = "".join(rng.choice((random_page(rng, depth + 1), "some words of text " * rng.randrange(6), "<br>")) if depth < 4 else "leaf text " for _ in range(rng.randrange(1, 5)))
    return f"<{tag}>{inner}</{tag}>"


@pytest.mark.parametrize("seed", range(30))
def test_densities_and_selection_match_brute_force(seed):
    body = H.parse(f"<body>{''.join(random_page(random.Random(seed * 50 + k)) for k in range(4))}</body>")
    order = H._measure(body)
    nodes = list(below(body))
    assert {id(x) for x in order} == {id(x) for x in nodes}
    cb, _, lcb, _ = brute(body)
    density = {}
    for x in nodes:
        c, t, lc, lt = brute(x)
        assert (x.c, x.t, x.lc, x.lt) == (c, t, lc, lt)
        density[id(x)] = 0.0
        if c:
            base = math.log(c / ((c - lc) or 1) * lc + lcb / (cb or 1) * c + math.e)
            inner = math.log(max(c / (lc or 1) * (t or 1) / (lt or 1), 1 + 1e-9))
            density[id(x)] = c / (t or 1) * (inner / math.log(base) if base > 1 + 1e-12 else inner)
        assert x.density == pytest.approx(density[id(x)])
    total = {id(x): sum(density[id(y)] for y in x.items if not isinstance(y, str) and not y.dropped) for x in nodes}
    core = max(order, key=lambda x: total[id(x)])
    path, up = [], core
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(density[id(x)] for x in path)
    marked = [max(below(x), key=lambda y: total[id(y)]) for x in nodes if density[id(x)] >= threshold - 1e-12]
    if total[id(core)] > 0:
        got = H._select(body, order)
        best = {round(total[id(x)], 6) for x in marked}
        assert {round(total[id(x)], 6) for x in nodes if id(x) in got} == best


def test_dense_parts_beside_the_core_are_taken_and_link_boxes_are_not():
    words = "Some running text of a paragraph that goes on for a while. " * 4
    page = f"<body><div><a href=1>One link</a> <a href=2>Another link</a> <a href=3>Third</a></div><div><h1>The title of this page</h1><div><p>{words}</p><p>{words}</p></div><div><p>{words}</p></div></div></body>"
    assert main_text(page) == "\n\n".join(["The title of this page"] + [words.strip()] * 3)


@pytest.mark.parametrize(
    "part,text",
    [
        ("<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is c.</p>", "The sum a+b is c."),
        ("<p><a href=1>Mostly a link it is</a>, <a href=2>and another</a>.</p>", "Mostly a link it is, and another."),
        ("<div class='share-price'>The price rose by two.</div>", "The price rose by two."),
        ("<section id=social-history><p>A history of towns.</p></section>", "A history of towns."),
        ("<div class='related-work'><p>Work by others.</p></div>", "Work by others."),
        ("<div class='comment-list'><p>Not me.</p></div>", None),
        ("<div class='cookie-notice site-box'>We use cookies.</div>", None),
        ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", None),
        ("<ul><li>First item</li><li>Second <a href=2>item</a></li></ul>", "First item\n\nSecond item"),
    ],
)
def test_nothing_of_the_article_is_dropped(part, text):
    want = ["Title here", "Opening words of the article, as many as a reader needs.", text, "Closing words of it."]
    assert main_text(f"<body><article><h1>{want[0]}</h1><p>{want[1]}</p>{part}<p>{want[3]}</p></article></body>") == "\n\n".join(w for w in want if w)


@pytest.mark.parametrize("page", ["<a \"", "<div>", "</b>", "<p><table><td>", "<ul><div><li></li>", "<a x ", "<a 'x\">", "<article>", "<!--", "<i></p>"])
def test_time_grows_with_the_length_only(page):
    seconds = []
    for n in (20_000, 80_000):
        start = time.process_time()
        main_text(page * n + "\">")
        seconds.append(time.process_time() - start)
    assert seconds[1] < 12 * seconds[0] + 0.5  # 16 times as much if it grew with the square
