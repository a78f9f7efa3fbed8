import math
import random

import pytest

from folioflow.llm import queries
from folioflow.llm import htmltext
from folioflow.llm.htmltext import Line, content, framed, main_text, read, smoothed
from tests.llm.common import save

LONG = "This paragraph is long enough to look like running text, as articles have it."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More of this site</a></li></ul></nav>"


@pytest.mark.parametrize("html,text", [
    ("", ""), (None, ""), ("<div><p></p></div>", ""), ("<script>x()</script><style>p{}</style>", ""),
    (f"<body>{MENU}<article><h1>T &amp; U</h1><p>{LONG}<p>Of.</article><footer>&copy; us</footer>", f"T & U\n\n{LONG}\n\nOf."),
    (f"<body><header>Site</header><main><p>a<br>b\n c&nbsp;d</p>{MENU}<p>{LONG}</main>", f"a b c d\n\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='ad banner'>Buy!</div><aside>Side</aside><form>Mail <input></form><div id=comments><p>{LONG} Me too.</p></div><p>End", f"{LONG}\n\nEnd"),
    (f"<article><p>{LONG}</p></article><section class='comments'><article class='comment'><p>{LONG} {LONG}</p></article></section>", LONG),
    (f"<div class=menu><a>a</a></div><div id=content><h2>Head</h2><p>{LONG}</p><p>No.</p><ul><li>one<li>two</ul></div><div class='cookie-notice'>{LONG}</div>", f"Head\n\n{LONG}\n\nNo.\n\none\n\ntwo"),
    (f"<nav><a>x</a><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><!-- <p>hidden</p> --><noscript>Turn on</noscript><p hidden>x</p><p style='display: none'>y</p><p>&lt;b&gt; &#8364; &am</p></article>", f"{LONG}\n\n<b> € &am"),
    ("just text & more", "just text & more"),
    (f"<article><p>{LONG * 4}</p><p>{LONG * 4}</p><p>{LONG * 4}</p></article><article><p><b>So.</b></p><p>It is.</p><p><i>Yes.</i></p></article><article><p>{LONG * 4}</p><p>{LONG * 4}</p></article>",
     f"{LONG * 4}\n\n{LONG * 4}\n\n{LONG * 4}\n\nSo.\n\nIt is.\n\nYes.\n\n{LONG * 4}\n\n{LONG * 4}"),
    (f"<div><p>{LONG * 4}</p><p>{LONG * 4}</p><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr><tr><td>c</td><td>3</td></tr></table><p>{LONG * 4}</p></div>",
     f"{LONG * 4}\n\n{LONG * 4}\n\na\n\n1\n\nb\n\n2\n\nc\n\n3\n\n{LONG * 4}"),
    (f"<article><p>{LONG}</p><p>cut <b", f"{LONG}\n\ncut <b"),
    ("<article><p><b>Sthe.<br><p>To it</article>", "Sthe.\n\nTo it"),
    # No article or main element.
    (f"<body><form><div>{MENU}</div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"Head\n\n{LONG}\n\n{LONG}"),
    (f"<body><div><p>{LONG * 3}</p><p>{LONG}</p></div><div><a href=a>One other page</a> | <a href=b>And one more</a> | <a href=c>Third</a></div></body>", f"{LONG * 3}\n\n{LONG}"),
    (f"<body><div><ul><li><a href=a>{LONG}</a></li><li><a href=b>{LONG}</a></li></ul></div><div><p>{LONG}</p></div></body>", LONG),
    (f"<body><div id=all><div><p>{LONG * 4}</p></div><div><ul><li><a href=a>More of it</a></ul></div><div><h2>Then</h2><p>Ok.</p></div><div><p>{LONG * 4}</p></div></div></body>",
     f"{LONG * 4}\n\nThen\n\nOk.\n\n{LONG * 4}"),
    (f"<body><div><p>{LONG}</p></div><form><p>Mail us.</p><input></form></body>", LONG),
    # Words that look like furniture, furniture inside, and what is round an article.
    (f"<article><div class='social-history'><p>{LONG}</p></div><p id='share-prices'>Up.</p><p class='ad-slot-2'>{LONG}</p><div class='shareButtons'>Tell</div><p class=widgets_2>x</p></article>", f"{LONG}\n\nUp."),
    (f"<div><p>{LONG * 9}</p></div><article><p>{LONG}</p><nav><p>{LONG}</p></nav><ul><li><a href=a>Source</a></li></ul></article>", f"{LONG}\n\nSource"),
    (f"<main><h1>Head</h1><div><a href=a>Back to all of it</a></div><article><p>{LONG}</p></article><article><a href=b>Read this too</a></article></main>", f"Head\n\n{LONG}"),
    (f"<form><nav><a href=a>a</a></nav><article><p>{LONG}</p><form><p>{LONG}</p></form></article></form>", LONG),
    (f"<nav><p>{LONG}</p></nav><p>{LONG} So.</p><div role=navigation>{LONG}</div>", f"{LONG} So."),
    ("<article><h1><a href=a>Only links</a></h1><nav>x</nav></article><div><a href=b>Other</a></div>", "Only links"),
    ("<div><a href=a>Only links</a></div>", ""),
    (f"<main></main><div><p>{LONG}</p></div>", LONG),
    (f"<article><p><a href=a>One<p>{LONG}</p></article>", f"One\n\n{LONG}"),
])
def test_pages(html, text):
    got = main_text(html)
    assert got == text or html and html.endswith("<b") and got in (text, f"{LONG}\n\ncut")


def test_smoothing():
    assert smoothed([]) == [] and smoothed([3.0]) == [3.0] and smoothed([1.0] * 9) == pytest.approx([1.0] * 9)
    assert max(smoothed([0.0, 0.0, 9.0, 0.0, 0.0])) < 9


def plainly(lines, around, menus):
    """The choice of lines, spelled out anew: every smoothed ratio from the whole sum, regions as sets of lines."""
    def weight(i, j):
        return math.exp(-((i - j) ** 2) / 2) if abs(i - j) <= 2 else 0.0

    n = len(lines)
    smooth = [sum(weight(i, j) * lines[j].ratio for j in range(n)) / sum(weight(i, j) for j in range(n)) for i in range(n)]
    dense = {i for i in range(n) if lines[i].ratio > 0 and smooth[i] >= 0.5 * sum(smooth) / n}
    if not dense:
        return [x for x in lines if x.root and x.region not in menus]
    of = {r: {i for i in range(n) if lines[i].region == r} for r in range(len(around))}
    talks = {r for r in of if any(lines[i].ratio > 0 for i in of[r])}
    if any(lines[i].root for i in dense):
        return [x for x in lines if x.root and x.region in talks]

    def under(r, top):
        while r and r != top:
            r = around[r]
        return r == top

    chosen = {r for r in talks if of[r] & dense}
    tops = [t for t in range(len(around)) if all(under(r, t) for r in chosen)]
    top = max(tops, key=lambda t: sum(under(t, other) for other in tops))
    more = {r for r in talks if top and around[top] and under(r, top)} | {r for r in talks if min(dense) < min(of[r]) and max(of[r]) < max(dense)}
    return [x for x in lines if x.region in chosen | more]


def test_choice_like_plain():
    rng = random.Random(5)
    for _ in range(400):
        around = [0, *(rng.randrange(i) for i in range(1, 8))]
        rooted = rng.random() < 0.3
        menus = {r for r in range(1, 8) if rng.random() < 0.2}
        root = {r: rng.randrange(3) if rooted else 0 for r in range(8)}
        lines = []
        for _ in range(rng.randrange(1, 25)):
            r = rng.randrange(8)
            lines.append(Line("x", 0.0 if r in menus or rng.random() < 0.4 else rng.choice((1.0, 5.0, 80.0, 300.0)), r, root[r], 0))
        assert content(lines, around, menus) == plainly(lines, around, menus)


def test_the_threshold_decides(spark, sf_dir):
    """On every page some lines are left out by their ratio; with no threshold the result is another on all of them."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    found = [read(h) for h in pages]
    assert all(len(content(p.lines, p.around, p.menus)) < len(p.lines) for p in found)
    assert all("\n\n".join(x.text for x in framed(p.lines)) != main_text(h) for p, h in zip(found, pages))
    for p in found:
        kept = content(p.lines, p.around, p.menus)
        assert kept == plainly(p.lines, p.around, p.menus) and all(not x.ratio for x in p.lines if x not in kept)


def test_names():
    hit = lambda v: htmltext.named(v, htmltext.SKIPPED_WORDS)
    assert all(map(hit, ("ad", "x ad-slot-12", "commentList", "cookie-notice", "site_sidebar", "related-posts", "AD1")))
    assert not any(map(hit, ("", "-", "header", "social-history", "share-prices", "commentary", "adverbs", "notice-of-death", "12")))


def test_query(spark, sf_dir, tmp_path):
    rows = queries.op10_html_text(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.text == main_text(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)
    assert all(r.text and "track(" not in r.text for r in rows)
    hard = spark.createDataFrame([(1, None, None, "own"), (1, None, None, "own"), (2, "u", "<p>🙂</p>" * 20_000, "own")], "page_id long, url string, html string, text string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in queries.op10_html_text(spark, save(hard, tmp_path, "pages")).collect())
    assert found[:2] == [(1, "", 0)] * 2 and found[2][1] == "\n\n".join(["🙂"] * 20_000)
    assert queries.op10_html_text(spark, save(hard.limit(0), tmp_path / "none", "pages")).count() == 0
