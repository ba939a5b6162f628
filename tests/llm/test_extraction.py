"""HTML extraction: cuts against all labellings, pages against their articles."""

import html
import itertools
import random
import re

from veilframe.llm import extraction as x
from veilframe.llm.extraction import main_text
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_cut_against_all_labellings():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(1, 8)
        source, sink = [rng.randint(0, 20) for _ in range(n)], [rng.randint(0, 20) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 9)) for a, b in itertools.combinations(range(n), 2) if rng.random() < .4]

        def cost(keep):
            return (sum(sink[i] if k else source[i] for i, k in enumerate(keep)) + sum(w for a, b, w in edges if keep[a] != keep[b]))
        assert cost(x.minimum_cut(source, sink, edges)) == min(map(cost, itertools.product((True, False), repeat=n)))


def test_long_chain():
    n = 3000
    keep = x.minimum_cut([100] + [1] * (n - 1), [0] + [2] * (n - 2) + [100], [(i, i + 1, 3) for i in range(n - 1)])
    assert keep[0] and not keep[-1]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body class="page ad-free">
<header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class="cookie-notice"><p>We use cookies, as everybody does, and so on and on.</p></div>
<main><article><header><h1>A&nbsp;title &lt;here&gt;</h1></header><p>First <b>bold</b>ed   text<br>goes on, with an &eacute; and &#8211; more.<p>Second, unclosed one.
<aside>Read also: something else entirely, with many words in it.</aside><div class="ad">Buy now, buy this fine thing today.</div><ul><li>One.</li><li>Two</li></ul>
<form><label>Mail</label><input><button>Send</button></form><table><tr><td>a</td><td>b</td></tr></table><p>Last.</p></article>
<section id="comments"><p>Nice article, I liked it a lot. Really, it is very good.</p></section></main><div id="sidebar">Side text, which is long enough to look real.</div>
<footer>&copy; me</footer></body></html>"""


def test_page():
    assert x.main_text(PAGE) == "A title <here> First bolded text goes on, with an é and – more. Second, unclosed one. One. Two a b Last."


def test_page_without_article():
    body = "The main text of the page is a long sentence, with commas, and it goes on for quite some words. " * 3
    page = f"<body><ul class=menu><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div><p>{body}</p><p>Short end.</p></div><div class='footer'>(c) 2024, all rights reserved, everywhere.</div>"
    assert x.main_text(page) == " ".join((body + " Short end.").split())


def test_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "plain text"), (4, "<p>cut off <b"), (5, "<script>never closed"), (None, "<article><p>x &am</p></article>"),
             (6, "<article>" + "<p>long, long text.</p>" * 20000), (6, "<div>" * 3000 + "deep text, very deep."), (7, "<p>a</p>\x00 & &#0; &bogus; <!-- <p>b</p> --> <![CDATA[q]]>")]
    frame = spark.createDataFrame([(i, h, "t", 1) for i, h in pages], "page_id bigint, html string, text string, _html int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in x.extract(frame).collect()]
    assert len(got) == len(pages) and all(len(t) == n for _, t, n in got)
    texts = [t for _, t, _ in got]
    assert texts[:2] == ["", ""] and texts[4] == "" and texts[5] == "x &am" and texts[6] == " ".join(["long, long text."] * 20000)
    assert x.extract(frame.limit(0)).count() == 0


def test_query_against_articles(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1]
        want = html.unescape(re.sub(r"</?(?:b|a)\b[^>]*>", "", re.sub(r"<(?!/?b>|/?a\b)[^>]*>", " ", article)))
        assert r["text"] == " ".join(want.split()) and r["n_chars"] == len(r["text"])


def test_names_do_not_bar_the_article():
    body = "The main text of the page is a long sentence, with commas, and it goes on for quite some words. " * 3
    want = " ".join(("A title " + body + "Short end.").split())
    text = f"<h1>A title</h1><p>{body}</p><p>Short end.</p>"
    side = "<div class=sidebar><p>Side text, which is long enough to look real.</p></div>"
    comments = "<div id=comments><p>Nice article, I liked it a lot. Really, it is very good.</p></div>"
    for page in (f"<div class='layout has-sidebar'><main><article>{text}</article></main>{side}</div>",
                 f"<article class='post comments-open'>{text}{comments}</article>",
                 f"<div class='search-form-page'><article>{text}</article>{side}</div>",
                 f"<div class='search-form-page'><div>{text}</div>{side}</div>",
                 f"<main><div class='entry menu-open'>{text}</div>{comments}</main>",
                 f"<article><section id='form-validation'><h2>A title</h2><p>{body}</p></section><section><p>Short end.</p></section></article>"):
        assert x.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == want, page


def test_head_without_end_tag():
    article = "<article><p>The main text of the page, with commas, is here.</p></article>"
    for start in ("<head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title><style>p{}</style>", "<head><title>T</title><body class=x><nav>Home</nav>"):
        assert x.main_text(f"<!DOCTYPE html><html>{start}{article}") == "The main text of the page, with commas, is here."
    assert x.main_text("<html><head><title>T</title>Bare text of a page, without any tags.") == "Bare text of a page, without any tags."


def test_marks_around_the_article_are_finite():
    said = " ".join(f"This is a long sentence, number {i}, with commas, and words that say something." for i in range(9))
    article = f"<article><h1>The title</h1><p>{said}</p>"
    remarks = '<div class="reader-responses"><p>I liked this a lot, thank you, it was good to read. Really.</p></div>'
    want = f"The title {said}"
    for page in (f'<body><form id="aspnetForm"><nav>Home About</nav>{article}</article><footer>Imprint</footer></form></body>', f'<html aria-hidden="true"><body>{article}</article></body></html>',
                 f'<body><div hidden>{article}</article></div></body>', f"<body>{article}</article>{remarks}</body>", f"<body>{article}{remarks}</article></body>",
                 f"<body>{article}<form><p>Subscribe to our letter, it is free, and good for you.</p></form></article></body>",
                 f'<body>{article}<p aria-hidden="true">Not shown, whatever it says, to anybody who reads this.</p></article></body>'):
        assert main_text(page) == want, page[:80]
