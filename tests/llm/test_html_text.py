import html
import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.llm.html_text import extract, main_text
from recollect.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = "This sentence is long enough to count as text of an article, with many plain words in it."


def plain(page):
    """Blocks between the article tags of the test pages, which are all built alike."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_against_plain_reading(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op1_html_text"](spark, SF).collect()}
    want = {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert got == want


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><div id=menu><a href=x>One</a><a href=y>Two</a></div><div class='post'><h2>Head line</h2><p>{LONG}<p>{LONG}</div><div class='comments'><p>{LONG}</p></div>", f"Head line\n{LONG}\n{LONG}"),
        (f"<header>Site</header><main><header><h1>T</h1></header><p>a&amp;lt; <i>b</i>c<aside>{LONG}</aside><p>end</main><footer>F</footer>", "T\na&lt; bc\nend"),
        (f"<div class='page with-sidebar'><article><p>x<script>var a='<p>no</p>'</script> y</p><div class=newsletter>{LONG}</div><ul><li>one<li>two</ul></article></div>", "x y\none\ntwo"),
        ("<article><p>1 < 2 &nbsp; and\n\t3</p><!-- <p>gone</p> --><form><p>no</p></form></article", "1 < 2 and 3"),
        (f"<p>{LONG}</p><p>{LONG}</p><section class='comment-list'><article class='comment'><p>{LONG}</p></article></section>", f"{LONG}\n{LONG}"),
        ("", ""),
        (None, ""),
        ("<nav>only menu</nav>", ""),
        ("plain words", "plain words"),
        ("<article><p>cut <b>off", "cut off"),
        # the distribution decides within articles, too: rows of links at the ends
        ("<article><h1>T</h1><p>One.</p><p><a href=n>Next story</a> | <a href=s>Share</a> | <a href=p>Print</a></p></article>", "T\nOne."),
        ("<article><ul><li><a>A</a><li><a>B</a></ul><p>One.</p><p><a>a link of its own</a></p><p>Two.</p><ul><li><a>A</a><li><a>B</a><li><a>C</a></ul><p>Three.</p></article>", "A\nB\nOne.\na link of its own\nTwo.\nA\nB\nC\nThree."),
        # names in slugs, controls in lines, lists of reading and short paragraphs are text
        (
            "<article><h1>T</h1><p>One.</p><h2 id='related-work'>Related work</h2><p>Two.</p><p class='share-price'>Shares rose by two.</p><section id='notice-period'><p>Notice must be given in March.</p></section></article>",
            "T\nOne.\nRelated work\nTwo.\nShares rose by two.\nNotice must be given in March.",
        ),
        ("<main><div id='search-results-explained'><p>How results are found.</p></div></main>", "How results are found."),
        ("<article><p>Press the <button>Start</button> button, then <label>Name</label> it.</p><button>Share</button><p>Done.</p></article>", "Press the Start button, then Name it.\nDone."),
        ("<article><p>Read on:</p><ul><li><a>A book</a><li><a>A film</a><li><a>A song</a></ul><p><a>The whole list</a></p></article>", "Read on:\nA book\nA film\nA song\nThe whole list"),
        (f"<p>{LONG * 20}</p><div class=advert>Buy!</div><p>A short paragraph after it.</p><div class='ad-box'>More!</div><p>And one more to end.</p>", f"{LONG * 20}\nA short paragraph after it.\nAnd one more to end."),
        (f"<div class='site-header'>Name</div><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div><div id='comments-section'><p>{LONG}</p></div><div class='footerLinks'>x</div>", LONG),
        ("<article><p title=don't>One first</p><p>it's two</p><p>three</p></article>", "One first\nit's two\nthree"),
        ("<article><p title='a > b' class = \"x>y\" data-x=5>One</p></article>", "One"),
        ("<p>The shop is closed on Mondays.</p><nav><a>Home</a></nav><p>We open again on Tuesday at nine.</p>", "The shop is closed on Mondays.\nWe open again on Tuesday at nine."),
        (f"<p>{'Intro words. ' * 25}</p><aside>{LONG}</aside>" + f"<p>{LONG * 8}</p>" * 3 + "<p><a>One</a></p>", "\n".join([("Intro words. " * 25).strip(), *[LONG * 8] * 3])),
        (f"<div class='content with-sidebar'><p>{LONG}</p><div class=sidebar>{LONG[:40]}</div></div><div class=footer>x</div>", LONG),
        (f"<div class='layout nav-fixed'><div class='menu-wrap'><p>{LONG}</p><p>{LONG}</p></div><div class=promo>Buy now.</div></div>", f"{LONG}\n{LONG}"),
        ("<p><a href=x>only</a></p><p><a href=y>links</a></p>", ""),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_odd_rows(spark):
    rows = [(1, None, None, "t"), (1, "u", "", "t"), (None, "u", "<p>" + "word " * 50_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.url, r.n_chars) for r in extract(pages).collect()), key=str) == [(1, "u", 0), (1, None, 0), (None, "u", 249_999)]
    assert extract(pages.where(F.lit(False))).count() == 0


def test_generated_pages(spark):
    """Pages with names at random: what was put in the article comes back, and nothing of what was put beside it."""
    rng = random.Random(4)
    slugs = "related-work share-price notice-period search-results-explained cookie-recipes banner-of-war social-history comment-on-method menu-of-options reply-to-critics".split()
    beside = "related-posts share-buttons cookie-banner social-links comment-list site-footer main-nav newsletter-form widget-area sidebar".split()
    words = lambda n: " ".join(rng.choice("the of rain river walked slowly under old bridges while people talked about prices".split()) for _ in range(n)).capitalize() + "."
    pages, want = [], {}
    for i in range(120):
        marked, blocks, parts = rng.random() < 0.5, [], []
        for _ in range(rng.randrange(2, 9)):
            kind, text = rng.choice(["p", "p", "p", "h2", "section", "li", "blockquote"]), words(rng.randrange(8, 60))
            name = rng.choice(["", f" id='{rng.choice(slugs)}'", f" class='{rng.choice(slugs)}'"])
            blocks.append(text)
            body = f"{html.escape(text)} <button>Go</button> <a href=x>there</a> now." if rng.random() < 0.2 else html.escape(text)
            blocks[-1] += " Go there now." if "<button>" in body else ""
            parts.append(f"<ul><li{name}>{body}</ul>" if kind == "li" else f"<{kind}{name}>{body}</{kind}>")
            if rng.random() < 0.4:
                parts.append(f"<div class='{rng.choice(beside)}'><p>{words(20)}</p></div>")
        around = f"<nav>{words(5)}</nav><div class='{rng.choice(beside)}'><a>Home</a> <a>News</a></div>"
        tag = "article" if marked else "div"
        pages.append((i, "u", f"<html><head><title>t</title></head><body>{around}<{tag}>{''.join(parts)}</{tag}><footer>{words(9)}</footer></body></html>"))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
