import collections
import html
import math
import os
import re

import duckdb
import pytest

from tramline.llm import site_style

SCHEMA = "page_id long, url string, html string, host string, nodes string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "n") for r in rows], SCHEMA)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in site_style.extract(frame(spark, rows)).collect()}


def test_marked_furniture_goes():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>'
        '<nav><ul><li><a href="/">Home</a></ul></nav><div class="ad-slot">Buy</div><div id="cookieNotice">We use</div><article><h1>A &amp; B</h1>'
        "<p>One <b>two<br>three</b> x&nbsp;y<p>Next<!-- no --> &lt;tag&gt;<form>f</form><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table>"
        '<section class="comments"><article><p>me too</p></article></section></article><aside>s</aside><footer>f</footer>'
    )
    assert site_style.main_text(page, None) == "A & B\nOne two three x y\nNext <tag>\na\nb\n1 2"


def test_broken_markup():
    cases = {"": "", "plain": "plain", "a < b": "a < b", "<p>x <!-- open": "x", "<p>x<script>y": "x", '<p class="a>b</p>c': "b\nc", "<p>a</div>b": "ab", "<": "<", "</": "", "<p>&bogus; &#x41;": "&bogus; A"}
    for page, want in cases.items():
        assert site_style.main_text(page, None) == want, page
    assert site_style.main_text(None, None) == ""
    assert site_style.main_text("<div>" * 5000 + "deep" + "<b <" * 2000, None).startswith("deep")


def test_low_importance_branches_of_a_host_go(spark):
    rows = []
    for i in range(12):
        body = f'<div class="wrap"><div class="boiler"><p>Terms of use apply to every page</p><p>All rights kept</p></div><div class="story"><p>Story {i} says {"w%d " % i * 30}</p></div></div>'
        rows.append((i, f"https://site.test/{i}", f"<html><body>{body}</body></html>"))
    rows.append((99, "https://other.test/1", rows[0][2]))
    got = texts(spark, rows)
    assert got[3].startswith("Story 3") and "Terms" not in got[3] and "rights" not in got[3]
    assert "Terms" in got[99]


def test_copies_on_a_host_keep_their_text(spark):
    page = "<body><nav>n</nav><article><h1>Title</h1><p>Same text here</p></article></body>"
    rows = [(i, f"https://copy.test/{i}", page.replace("nav>n", f"nav>n{i}")) for i in range(30)]
    assert set(texts(spark, rows).values()) == {"Title\nSame text here"}


def test_equal_pages_of_a_host_count_once(spark):
    page = lambda i, more="": f'<body><div class="story"><p>Story {i} says {"w%d " % i * 30}</p>{more}</div></body>'
    rows = [(i, f"https://equal.test/{i}", page(i)) for i in range(12)]
    rows += [(100 + i, f"https://equal.test/copy?v={i}", page(50, "<blockquote>Said once, on a page with copies</blockquote>")) for i in range(8)]
    got = texts(spark, rows)
    assert all(got[100 + i].endswith("Said once, on a page with copies") for i in range(8))


def test_small_branches_go_though_together_over_half(spark):
    again = "".join(f'<div class="{c}"><p>{t}</p></div>' for c, t in (("site", "This site is run by a few people"), ("writer", "The author lives in a small town"), ("legal", "No warranty is given for any of it")))
    rows = [(i, f"https://short.test/{i}", f'<body><div class="wrap"><div class="story"><p>Story {i} is short, w{i} x{i}</p></div>{again}</div></body>') for i in range(12)]
    assert texts(spark, rows) == {i: f"Story {i} is short, w{i} x{i}" for i in range(12)}


def brute_low(pages):
    """Low-importance nodes of one host's pages, as paths: the definitions, page by page."""
    shown, texts, styles, below = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(list)
    for page in dict.fromkeys(pages):
        children, seen = collections.defaultdict(list), set()
        for b in site_style.blocks(page):
            seen.add((b.path, b.text))
            children[b.path]
            for d in range(1, len(b.path)):
                own = children[b.path[:d]]
                if not own or own[-1] != b.path[d]:
                    own.append(b.path[d])
        for path, own in children.items():
            shown[path] += 1
            styles[path][tuple(own)] += 1
        for path, text in seen:
            texts[path][text] += 1
    leaf = {p: 1 - sum(math.log(f) for f in c.values()) / len(c) / math.log(shown[p]) if shown[p] > 1 else 1.0 for p, c in texts.items()}
    for p, x in leaf.items():
        for d in range(1, len(p)):
            below[p[:d]].append((len(texts[p]), x))
    nodes = [(p, x) for p, x in leaf.items()]
    for p, parts in below.items():
        h = -sum(f / shown[p] * math.log(f / shown[p]) for f in styles[p].values()) / math.log(shown[p]) if shown[p] > 1 else 1.0
        nodes.append((p, (1 - site_style.GAMMA) * h + site_style.GAMMA * sum(n * x for n, x in parts) / sum(n for n, _ in parts)))
    return {p for p, x in nodes if 1 - (1 - x) * shown[p] / (shown[p] + 1) < site_style.THRESHOLD}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_l/pages.parquet"), reason="needs the large tables")
def test_tree_matches_brute_force_and_needs_no_hints(spark):
    """A host of check_l: its furniture is drawn from 57 variants, so it takes thousands of pages to tell."""
    path = "/root/testdata/check_l/pages.parquet"
    table = spark.read.parquet(path).withColumn("host", site_style._host()).where("host = 'blog.tionble.example.com'").select("page_id", "url", "html")
    pages = [r["html"] for r in table.collect()]
    low = brute_low(pages)
    (got,) = site_style.low_importance(table).collect()
    assert set(got["nodes"]) == {site_style.node(p) for p in low}
    assert {p[2] for p in low} == {"nav", "div.ad", "footer"}
    for page in pages[:200]:
        assert site_style.main_text(page, got["nodes"], hints=False) == site_style.main_text(page, None)
        assert site_style.main_text(page, None, hints=False) != site_style.main_text(page, None)


def test_tree_matches_brute_force_on_made_pages(spark):
    rows = []
    for i in range(40):
        legal = "<div class=legal><h2>Legal</h2><p>All rights kept</p></div>" if i % 5 else "<div class=legal><p>Other terms</p></div>"
        side = f"<div class=side><p>Pick {i % 3}</p><span>of the day</span></div>"
        body = f"<div class=story><h2>Summary</h2><p>Story {i} of w{i * 7}</p><p>Part {i // 2}</p><blockquote>Quote {i}</blockquote></div>"
        rows.append((i, "https://made.test/x", f"<html><body>{side}{body}{legal}</body></html>"))
    rows += rows[:4]
    low = brute_low([r[2] for r in rows])
    (got,) = site_style.low_importance(frame(spark, rows)).collect()
    assert set(got["nodes"]) == {site_style.node(p) for p in low} and low
    assert texts(spark, rows) == {i: f"Summary\nStory {i} of w{i * 7}\nPart {i // 2}\nQuote {i}" for i in range(40)}


def test_text_that_only_looks_like_furniture_stays():
    cases = {
        '<p title="a hidden gem">one</p>': "one",
        "<p data-hidden=x title='role=navigation'>two</p>": "two",
        '<div class="social-history"><p>three</p></div>': "three",
        '<div id="search-results"><p>four</p></div>': "four",
        '<p>See <a href="/x">the whole long text of the link</a></p><p>five</p>': "See the whole long text of the link\nfive",
        '<ul><li><a href="/x">one link</a></li><li>six</li></ul>': "one link\nsix",
        "<p hidden>seven</p><p>eight</p>": "eight",
        '<div class="social-links">a</div><div id="siteFooter">b</div><div class="x reader-comments">c</div><p>nine</p>': "nine",
        "<ul><li><a href=/1>a</a><li><a href=/2>b</a><li><a href=/3>c</a></ul><p>ten</p>": "ten",
        "<p>eleven <button>Share</button> words</p>": "eleven words",
        "<article class='post has-sidebar'><p>twelve</p></article><p>thirteen</p>": "twelve",
    }
    for page, want in cases.items():
        assert site_style.main_text(page, None) == want, page


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (2, "not a url", None), (None, "http://u@h.test:80/x", ""), (3, "http://h.test/", "<p>b</p>"), (3, "http://h.test/", "<p>b</p>"), (4, "http://h.test/", "<p>" + "long " * 50_000)]
    out = site_style.extract(frame(spark, rows))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"] or 0, r["text"]) for r in out.collect())
    assert got == [(0, ""), (1, "a"), (2, ""), (3, "b"), (3, "b"), (4, ("long " * 50_000).strip())]
    assert site_style.extract(frame(spark, [])).collect() == []


def test_table_matches_plain_cutting(spark):
    path = "/root/testdata/sf0.1/pages.parquet"
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in site_style.extract(spark.read.parquet(path)).collect()}
    rows = duckdb.sql(f"select page_id, html from '{path}'").fetchall()
    assert len(rows) == len(got)
    for i, page in rows:
        article = page[page.index("<article>") : page.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<article>", article))
        want = "\n".join(x for x in parts if x)
        assert got[i] == (want, len(want))
