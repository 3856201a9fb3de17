"""HTML extraction: tree matching against its plain recursion, wrappers on hosts with and without telling tags."""

import random
import time
from functools import lru_cache

import pytest

from graphloom.llm import dom, webpages


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "keep") for r in rows], "page_id bigint, url string, html string, text string")
    out = webpages.extract(df).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    return {r["page_id"]: r["text"] for r in out}


PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body>
<div class="top">Our site</div><nav><a href=/>Home {i}</a></nav><div class="cookie-notice">We use cookies {i}</div>
<div><h1>Title {i} &amp; more</h1><p>First   part
of <b>page</b> {i}<br>goes&nbsp;on<p>Second &lt;part&gt; {i}</p><p>Share this text</p><ul><li>one {i}</li><li>two</ul></div>
<div id="comments"><p>reader {i}</p></div><form><p>mail {i}</p></form><footer>&copy; {i}</footer></body></html>"""


def test_wrapper_of_a_host(spark):
    rows = [(i, f"http://a.example.com/{i}", PAGE.format(i=i)) for i in range(12)]
    rows += [(50, "http://b.example.com/", PAGE.format(i=50)), (51, None, None), (52, "x", ""), (53, "http://c.example.com/", "no tags &am here"), (0, *rows[0][1:])]
    by = extracted(spark, rows)
    varying = "Title {i} & more\n\nFirst part of page {i} goes on\n\nSecond <part> {i}\n\none {i}"
    assert by[3] == varying.format(i=3)
    assert by[50] == varying.format(i=50).replace("\n\none", "\n\nShare this text\n\none") + "\n\ntwo"  # nothing to align with
    assert (by[51], by[52], by[53]) == ("", "", "no tags &am here")
    assert extracted(spark, []) == {}


def opaque(i, rng):
    """No tag or class says what is what: menu, notice, advert, text, list of links, imprint."""
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) + str(rng.randrange(99)) for _ in range(n))
    body = [f"Par {i} {say(30)}" for _ in range(rng.randint(2, 6))]
    page = (
        "<body><div class=k1><ul>" + "".join(f"<li><a href=/{w}>{w} {i}</a>" for w in say(5).split()) + "</ul></div>"
        "<div class=k2>The house has moved, note the new address</div>" + f"<div class=k3>{say(4)}</div>"
        f"<div class=k4><h1>Head {i}</h1>" + "".join(f"<p>{b}</p>" for b in body) + "<p>All texts are free to share</p></div>"
        f"<div class=k5>&copy; {i} {say(3)}</div></body>"
    )
    return page, "\n\n".join([f"Head {i}", *body])


def test_slots_decide_where_no_tag_tells(spark, monkeypatch):
    rng = random.Random(3)
    pages = [opaque(i, rng) for i in range(40)]
    rows = [(i, f"http://o.example.com/{i}", p) for i, (p, _) in enumerate(pages)]
    got = extracted(spark, rows)
    assert all(got[i] == want for i, (_, want) in enumerate(pages))
    without = [webpages.main_text(p) for p, _ in pages]
    assert sum(w != want for w, (_, want) in zip(without, pages)) >= 36  # without the wrapper most pages come out otherwise
    monkeypatch.setattr(webpages, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(webpages, "SALT_PAGES", 7)
    assert extracted(spark, rows) == got


def test_every_page_of_a_host_counts(spark):
    def page(top, i):
        return f"<html><body>{top}<section><p>Text {i} of this page</p></section></body></html>"

    tops = ["<div>Layout one</div>", "<table><tr><td>Layout two</table>", "<ul><li>Layout three</ul>"]
    rows = [(f"http://h{n}x{k}.example.com/{i}", page("<div>Banner</div>", i)) for n in (2, 3, 4) for k in range(40) for i in range(n)]
    rows += [(f"http://big.example.com/{i}", page(tops[i % 3], i)) for i in range(60)]
    texts = list(extracted(spark, [(i, *r) for i, r in enumerate(rows)]).values())
    assert not [t for t in texts if "Banner" in t or "Layout" in t or not t.startswith("Text")]


def test_two_pages_that_share_an_article(spark):
    rows = [(i, f"http://t.example.com/{i}", f"<body><div>Top</div><article><p>The same text</p></article><div>{i}</div>") for i in range(2)]
    assert set(extracted(spark, rows).values()) == {"The same text"}


def test_regions_by_name_and_broken_markup():
    t = webpages.main_text
    assert t("<body><div>menu</div><article><header>top</header><h1>A</h1><p>b<p>c <!-- no --> d<aside>e</aside></article><p>f") == "A\n\nb\n\nc d"
    assert t("<article><p>a</p><script>if (1 < 2) {}</script><style>p{}</style><p>b</p>") == "a\n\nb"
    assert t("<article><p>x<script>never closed <p>y") == "x"
    assert t("<main><table><tr><td>1<td>2<tr><td>3</table></main>") == "1\n\n2\n\n3"
    assert t("<div><a href=a>one</a> <a href=b>two</a></div><p>text with a <a href=c>link</a> in it</p>") == "text with a link in it"
    assert t('<p title="5" tall">Hello there</p>') == "Hello there"
    assert t("<article><p>a <span hidden>no <span>no</span></span>b <span class=\"ad\">no</span> c</p></article>") == "a b c"
    assert t('<div class="article-body notice-board"><p>kept</p></div>') == "kept"
    assert t('<body class="nav-open with-sidebar"><article><p>real</p><div class="comments"><p>no</p></div></article>') == "real"
    assert t('<div class="related work"><p>earlier texts</p></div>') == "earlier texts"
    teaser = "<article><h2>Short</h2></article>" + "<div>" + "<p>the real and long body of it</p>" * 5 + "</div>"
    assert t(teaser).count("real") == 5 and "Short" not in t(teaser)
    assert t("a < b and <em>c</em> <unfinished tag") == "a < b and c"


HARD = {
    "paragraphs": "<article>" + "".join(f"<p>w{i}</p>" for i in range(20_000)) + "</article>",
    "blocks": "<body>" + "".join(f"<div>w{i}</div>" for i in range(20_000)),
    "nested": "<div>" * 20_000 + "deep",
    "quotes": "<p a\" " * 20_000 + ">x" + "<a b=\"' " * 5_000,
    "open": "<a " * 30_000,
    "items": "<ul><li><ul>" + "<div>" * 10_000 + "<li></li>" * 10_000,
    "mixed": "<body>" + "".join(f"<h2>w{i}</h2><p>x" + "<ul><li>z</ul>" * (i % 3) for i in range(5_000)),
}


@pytest.mark.parametrize("name", list(HARD))
def test_long_deep_and_broken_pages_on_both_sides(name):
    started = time.monotonic()
    a, b = dom.parse(HARD[name]), dom.parse(HARD[name].replace("w1", "<b>v</b>").replace("deep", "<p>deep") + "<div>z<p>1</div>")
    found = dom.match(a, b)
    again = dom.Tree.unpack(b.pack())
    assert dom.match(again, a)[0] == 0 and len(found) == len(a.parent)
    webpages.main_text(HARD[name], webpages.alone(b))
    assert time.monotonic() - started < 20


def naive(a, b):
    """Simple tree matching as published, and the nodes that can be paired at all (one of each run)."""

    @lru_cache(None)
    def w(x, y):
        if a.label[x] != b.label[y]:
            return 0
        xs, ys = a.groups[x], b.groups[y]
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i in range(1, len(xs) + 1):
            for j in range(1, len(ys) + 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w(xs[i - 1][0], ys[j - 1][0]))
        return m[-1][-1] + 1

    return w(0, 0)


@pytest.mark.parametrize("cells", [dom.CELLS, 4])
def test_tree_matching_is_maximal(cells, monkeypatch):
    monkeypatch.setattr(dom, "CELLS", cells)

    def grown(rng, depth):
        return "".join(f"<{t}>" + (grown(rng, depth - 1) if depth else "t") + f"</{t}>" for t in rng.choices(["div", "section", "h2", "p"], k=rng.randint(0, 5)))

    for seed in range(200):
        rng = random.Random(seed)
        a, b = dom.parse(grown(rng, 2)), dom.parse(grown(rng, 2))
        shapes = dom.Shapes()
        found = dom.match(a, b, shapes)
        first, todo = [], [0]
        while todo:
            first.append(todo.pop())
            todo += [g[0] for g in a.groups[first[-1]]]
        assert naive(a, b) == shapes.weight(a.shape[0], b.shape[0]) == sum(found[i] >= 0 for i in first), seed
        for i in range(1, len(found)):
            if found[i] >= 0:
                assert a.label[i] == b.label[found[i]] and found[a.parent[i]] == b.parent[found[i]]


LONG = "".join(f"<p>Paragraph {i} of a long piece, with a good many words in it.</p>" for i in range(6))
NAMES = ["comments-free-story", "social-history", "menu-essay", "share-report", "article-comments", "comments"]


@pytest.mark.parametrize("name", NAMES)
def test_a_name_does_not_leave_out_the_article(spark, name):
    t = webpages.main_text
    alone = t(f'<body><div class="{name}">{LONG}</div></body>')
    assert alone.count("Paragraph") == 6
    assert t(f'<body><div class=top><a href=/>home</a></div><h1>T</h1><div class="{name}">{LONG}</div><footer>x</footer></body>') == "T\n\n" + alone
    rng = random.Random(name)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    parts = [[say(40) for _ in range(4)] for _ in range(8)]
    page = '<body><div>The house</div><div class="x"><h1>Head {i}</h1><div class="{name}">{text}</div></div><div class="newsletter">Mail us</div></body>'
    rows = [(i, f"http://n.example.com/{i}", page.format(i=i, name=name, text="".join(f"<p>{p}</p>" for p in own))) for i, own in enumerate(parts)]
    got = extracted(spark, rows)
    assert all(got[i] == "\n\n".join([f"Head {i}", *own]) for i, own in enumerate(parts))


def test_a_name_leaves_out_what_stands_beside_the_article():
    t = webpages.main_text
    short = "<p>The article is short but it is one, with some words.</p>"
    assert t(f"<body><div>{short * 3}</div><div class=comments>{LONG}</div></body>").count("Paragraph") == 0
    assert t(f"<body><article>{short}</article><div id=comments>{LONG}</div></body>").count("Paragraph") == 0
    inside = t(f'<body><div class="share-report">{LONG}<div class="comments"><p>a reader</p><p>another</p></div></div></body>')
    assert inside.count("Paragraph") == 6 and "reader" not in inside
    assert t('<article><p>a <span class="social-history">kept</span> <span class="ad">no</span> c</p></article>') == "a kept c"
