import os
import time
from html import unescape

import pytest

from probestack.llm import extract as module
from probestack.llm.extract import extract, main_text, op3_extract, smoothed, two_means

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PARA = "A sentence of ordinary length that says something or other about it. " * 3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this long sentence here look like content, really.</div>
<div class="layout"><article><h1>A   title &amp; more</h1><p><b>First</b> para&shy;graph with an <a href="#">inline
link</a>.<br>Second line.<p>Short.</p><aside>Aside text</aside><ul><li>one<li>two</ul>
<p>Another rather long paragraph of text, so that the region is plain to see.</p>
<section id="comments"><p>A reader's comment that is long enough to be content as well.</p></section></article>
<div id="sidebar"><p>Sidebar words</p></div><div class="ad">Buy now</div></div>
<form><p>Name</p><input name="q"></form><footer>&copy; 2020</footer></body></html>"""
WANT = "A title & more First para­graph with an inline link. Second line. Short. one two Another rather long paragraph of text, so that the region is plain to see."


def test_article():
    assert main_text(PAGE) == WANT


def test_pages_without_article_and_broken_markup():
    body = "<p>" + "Text of some length that goes on for a while. " * 5 + "</p>"
    page = f"<html><body><div class=menu><a>x</a> <a>y</a></div><div id=content>{body}<p>ok</p>{body}</div><div class='footer'>foot</div>"
    assert main_text(page).count("Text of") == 10 and " ok " in main_text(page) and "foot" not in main_text(page)
    assert main_text("<article><p>cut off & unclosed <b>bold") == "cut off & unclosed bold"
    assert main_text("plain words only") == "plain words only"
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == main_text("<!-- c -->") == ""
    assert main_text("<article>Ti.</article><nav>" + "<a>long menu entry of words</a>" * 50 + "</nav>") == "Ti."


def test_layouts():
    para = "A sentence of ordinary length that says something or other about it. " * 3
    body = f"<h2>Head</h2><p>{para}</p><p>ok</p><p>{para}</p>"
    want = " ".join(("Head " + para + "ok " + para).split())
    wrap = {
        "table": f"<table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td>{body}</td></tr></table>",
        "divs": f"<div id=topNav><a>One</a></div><div class=wrap><div class=post>{body}</div><div class='col sideBar'><p>{para}</p></div></div>",
        "main": f"<header><h1>Site</h1></header><main>{body}<div class=commentlist><p>{para}</p></div></main><footer>{para}</footer>",
        "comments": f"<article>{body}</article><section id=comments><article class=comment><p>{para}</p></article></section>",
        "notice": f"<div class='alert notice'>{para}</div><div hidden>{para}</div><div style='display: none'>{para}</div><div>{body}</div><div role=complementary>{para}</div>",
        "links": f"<div><ul><li><a href=1>First of the links</a><li><a href=2>Second of the links</a></ul>{body}</div>",
        "forms": f"<div>{body}<form><label>Mail</label><textarea>{para}</textarea><button>Go</button></form><select><option>x</select></div>",
    }
    for name, html in wrap.items():
        assert main_text(f"<html><head><title>{para}</title></head><body>{html}</body></html>") == want, name


def test_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (3, "u", "<article>" + "<p>w x</p>" * 20_000 + "</article>", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract(frame).collect())
    assert got == [(0, 0), (1, len(WANT)), (1, len(WANT)), (3, 4 * 20_000 - 1)]
    assert extract(frame.limit(0)).collect() == []


def test_kernels():
    assert smoothed([2.0] * 5) == [2.0] * 5 and smoothed([0, 0, 9, 0, 0])[2] < 9
    assert 1 < two_means([0, 1, 9, 10]) < 9 and two_means([3.0]) == 3.0


def test_all_seeds_are_kept_without_article():
    para = "A sentence of ordinary length that says something or other about it. " * 3
    nav = "<div class=menu><a href=1>x</a> <a href=2>y</a></div>"
    for parts in (
        [f"<div>{f'<p>{para}</p>' * 13}</div>", f"<div>{f'<p>{para}</p>' * 7}</div>"],
        [f"<p>{para}</p>", f"<pre>{para * 8}</pre>", f"<p>{para}</p>"],
        [f"<p>{para}</p>", f"<ul>{f'<li>{para}' * 8}</ul>", f"<p>{para}</p>"],
        [f"<p>{para}</p>", f"<table><tr><td>{para * 8}</td></tr></table>", f"<p>{para}</p>"],
    ):
        body = "".join(parts)
        got = main_text(f"<html><body>{nav}<div class=content>{body}</div><div class=footer>foot</div></body></html>")
        assert got.count("A sentence") == body.count("A sentence") and "foot" not in got and "x y" not in got


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "post tags-news", "nav-open", "single-post social", "page share", "header-fixed comments-open", "sidebar"])
def test_wrappers_never_empty_a_page(name):
    body = f"<h1>Head</h1><p>{PARA}</p><p>ok</p><p>{PARA}</p>"
    want = " ".join(f"Head {PARA} ok {PARA}".split())
    assert main_text(f"<body><div class='{name}'><article>{body}</article><aside>x</aside></div></body>") == want
    assert main_text(f"<body><div id='{name}'><div>{body}</div></div></body>") == want
    assert main_text(f"<body><nav>x</nav><div class='{name}'><div class=post>{body}</div></div><div class=footer>foot</div></body>") == want


def test_blocks_beside_the_article_stay_out():
    body = f"<p>{PARA}</p><p>{PARA}</p>"
    want = " ".join(f"{PARA} {PARA}".split())
    for beside in (f"<section id=comments><article class=comment><p>{PARA * 9}</p></article></section>", f"<div class=related><article><p>{PARA}</p></article></div>", f"<div class='cookie-notice'><p>{PARA}</p></div>", f"<div><p>{PARA}</p></div>"):
        assert main_text(f"<body>{beside}<article>{body}</article>{beside}</body>") == want


def test_ratios_select(monkeypatch):
    """Pages whose markup names nothing: what is content is decided by the smoothed ratios alone."""
    menu = "<div><ul>" + "".join(f"<li><a href={i}>Entry {i}</a></li>" for i in range(8)) + "</ul></div>"
    foot = "<div><span>Imprint</span> <span>Terms</span> <span>Help</span></div>"
    bodies = [f"<div><h2>Head</h2><p>{PARA}</p><p>ok</p><p>{PARA}</p></div>", f"<div><p>{PARA}</p><div>{menu}</div><p>{PARA}</p></div>"]
    wants = [" ".join(f"Head {PARA} ok {PARA}".split()), " ".join(f"{PARA} {PARA}".split())]
    pages = [f"<body>{menu}{x}{foot}</body>" for x in bodies] + [f"<article><p>{PARA}</p>{menu}<p>{PARA}</p></article>"]
    wants.append(wants[1])
    assert [main_text(p) for p in pages] == wants
    monkeypatch.setattr(module, "smoothed", lambda values, sigma=1.5: [1.0] * len(values))
    assert all(main_text(p) != want for p, want in zip(pages[:2], wants, strict=False))


def test_nesting_takes_linear_time():
    began = time.time()
    deep = "<div>x" * 160_000  # 1 MB of tags that nothing closes
    assert main_text(deep).count("x") == 160_000
    assert main_text("<b><div>" + "<i>" * 100_000 + "</b>" * 100_000 + "word").endswith("word")
    assert main_text("<span>" * 100_000 + "</p></li></td>" * 50_000 + "word").endswith("word")
    assert time.time() - began < 60


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_query_gives_the_article_of_every_page(spark):
    """The test pages have one article each, whose text blocks are read here by plain splitting."""
    def plain(html):
        inner = html.split("<article>")[1].split("</article>")[0]
        text, at = [], 0
        while at < len(inner):
            if inner[at] == "<":
                end = inner.index(">", at)
                text.append("" if inner[at + 1 : end].strip("/").lower() in ("b", "i", "a", "em") else " ")
                at = end + 1
            else:
                end = inner.find("<", at)
                end = len(inner) if end < 0 else end
                text.append(unescape(inner[at:end]))
                at = end
        return " ".join("".join(text).split())

    want = {r.page_id: (r.url, plain(r.html) if r.html else "") for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text) for r in op3_extract(spark, DIR).collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in op3_extract(spark, DIR).collect())
