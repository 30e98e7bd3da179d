"""Main text of web pages by site style trees.

The pages of one host are merged into a tree of element nodes (the path of tags and classes from the root), over all that a
page shows. A node's presentation features are the child sequences it is shown with; a block's content features are its texts.
Node importance is the entropy of its styles, content importance is one minus the mean entropy of its features over the pages
that have the node, and both are combined up the tree. What few pages say counts less, by m / (m + 1) for m of them. Branches
of low combined importance are the site's furniture and are removed from each page.

What HTML says of an element (menus, page headers, footers, asides, forms, adverts, comments, and what is outside a page's
article) is a hint that lowers the importance of its branch: a strong one, as comments and adverts differ from page to page
and so look like content to any statistics.

The host statistics are sums of counts per (host, node, feature), combined before any shuffle. The decisions, a few nodes
a host, are joined back by host: as a broadcast only if the written table is under Spark's own size threshold.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, tidy

#: Weight of the content below a node against its own styles.
GAMMA = 0.9
#: Branches under this combined importance go: those whose typical text is on more pages than the root of the pages they are on.
THRESHOLD = 0.5
#: Importance of a branch that HTML marks as no content, by weight: under the threshold whatever its entropy.
HINT = 0.15
#: So many link blocks in a row of one list are a menu.
MENU_LINKS = 3

# HTML's element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
SKIP = RAW | frozenset("head nav footer aside form button select option input label fieldset canvas object audio video dialog menu datalist map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody tfoot thead tr".split())
SELF_NESTED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr "
    "notice notices notification alert popup popover modal overlay newsletter subscribe subscription signup signin login sidebar sidebars widget widgets "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer comment comments respond replies disqus share sharing social "
    "related recommended recommendations search searchform toolbar masthead skip".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Words that stand beside those above in one class or id. With any other word ("social-history") it says nothing.
BESIDE_WORDS = frozenset(
    "site page main top bottom left right box bar list lists item items link links wrapper wrap container inner outer section area block slot unit zone "
    "header head title post posts article articles icon icons button buttons btn primary secondary global local inline content text col column row group "
    "panel module region holder reader readers user users more js id a b c".split()
)
PAGE_HEADERS = frozenset(("site-header", "global-header"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """``text`` as it counts for a page's content, ``whole`` with what is marked within the block. ``marked``: no content, says
    HTML. ``item``: of a list."""

    __slots__ = ("article", "heading", "item", "links", "marked", "path", "text", "whole")

    def __init__(self, path: tuple[str, ...], text: str, whole: str, links: int, article: bool, heading: bool, item: bool, marked: bool):
        self.path, self.text, self.whole, self.links, self.article, self.heading, self.item, self.marked = path, text, whole, links, article, heading, item, marked


@lru_cache(maxsize=4096)
def _furniture_name(token: str) -> bool:
    """Whether a class or id names furniture: by a word for it, and no word that may mean something else."""
    words = [x.lower() for x in _WORDS.findall(_CAMEL.sub(" ", token))]
    return "-".join(words) in PAGE_HEADERS or (not SKIP_WORDS.isdisjoint(words) and all(w in SKIP_WORDS or w in BESIDE_WORDS for w in words))


def _signature(name: str, raw: str) -> tuple[str, bool]:
    """A node's name in the tree, and whether its attributes mark it as no content."""
    if not raw or raw.isspace():
        return name, False
    marked, shown = False, name
    for m in _ATTR.finditer(raw):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "role":
            marked |= value.strip().lower() in SKIP_ROLES
        elif key == "hidden":
            marked = True
        elif key == "aria-hidden":
            marked |= value.strip().lower() == "true"
        elif key == "style":
            marked |= "display:none" in value.replace(" ", "").lower()
        elif key == "id" or key == "class":
            tokens = value.split()
            marked |= any(map(_furniture_name, tokens))
            if key == "class" and tokens:
                shown += "." + re.sub(r"\d+", "", ".".join(sorted(tokens)))
    return shown, marked


def blocks(page: str) -> list[Block]:
    """All blocks that the page shows, in its order, with white space and character references resolved."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, signature, marked, within an article or main, in the head
    parts: list[str] = []
    kept: list[str] = []  # of these, what isn't marked
    links = anchor = 0
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, kept, links
        if parts:
            whole = " ".join(html_lib.unescape("".join(parts)).split())
            if whole:
                text = whole if len(kept) == len(parts) else " ".join(html_lib.unescape("".join(kept)).split())
                inner = next((s[0] for s in reversed(stack) if s[0] in BLOCK), "")
                path = tuple(s[1] for s in stack if s[0] in BLOCK)
                out.append(Block(path, text or whole, whole, links, bool(stack) and stack[-1][3], inner in HEADINGS, inner in ("li", "dd", "dt"), not text))
            parts, kept, links = [], [], 0

    def put(piece: str) -> None:
        parts.append(piece)
        if not (stack and stack[-1][2]):
            kept.append(piece)

    def close(depth: int) -> None:
        nonlocal anchor
        while len(stack) > depth:
            name = stack[-1][0]
            if name in BLOCK:
                flush()
            elif name == "a":
                anchor = max(0, anchor - 1)
            stack.pop()

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos and not (stack and stack[-1][4]):
            piece = page[pos:at]
            put(piece)
            if anchor:
                links += len(piece)
        if at == n:
            break
        nxt = page[at + 1 : at + 2]
        if nxt == "!":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4 if not page.startswith("<!-->", at) else at + 2)
                pos = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            continue
        if nxt == "?":
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        m = (_TAG.match(page, at) or _LOOSE_TAG.match(page, at)) if nxt == "/" or nxt.isalpha() else None
        if m is None:
            if nxt == "/":
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            else:
                if not (stack and stack[-1][4]):
                    put("<")
                pos = at + 1
            continue
        pos = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "br":
                put(" ")
                continue
            if name == "p" and not any(s[0] == "p" for s in stack):
                flush()
                continue
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == name:
                    # an inline end tag doesn't close the blocks around it
                    if name in BLOCK or not any(s[0] in BLOCK for s in stack[d + 1 :]):
                        close(d)
                    else:
                        if name == "a":
                            anchor = max(0, anchor - 1)
                        del stack[d]
                    break
            if name in ("td", "th"):
                put(" ")
            continue
        raw = m[3]
        if name in RAW:
            end = _END[name].search(page, pos)
            if not raw.rstrip().endswith("/") or name not in ("svg", "math"):
                pos = n if end is None else end.end()
            put(" ") if name in ("svg", "iframe", "textarea") else None
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                put(" ")
            continue
        if name in CLOSES_P:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    close(d)
                    break
                if stack[d][0] in ("button", "table", "td", "th", "caption"):
                    break
        if name in SELF_NESTED:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == name or (name in ("dt", "dd") and stack[d][0] in ("dt", "dd")) or (name in ("td", "th") and stack[d][0] in ("td", "th")):
                    close(d)
                    break
                if stack[d][0] in SELF_NESTED[name]:
                    break
        if name in BLOCK:
            flush()
        elif name in ("td", "th"):
            put(" ")
        over = stack[-1] if stack else ("", "", False, False, False)
        shown, named = _signature(name, raw)
        within = over[3] or name in ("article", "main") or 'role="main"' in raw
        marked = (over[2] and name != "main") or name in SKIP or (name == "header" and not over[3]) or (named and name not in ("html", "body", "main"))
        if name == "a":
            anchor += 1
        stack.append((name, shown, marked, within and not marked, over[4] or name == "head"))
    close(0)
    flush()
    return out


def content(page: str | None, hints: bool = True) -> list[Block]:
    """The page's blocks with all hints: of a page with articles or a main element what is outside them, of another one the
    menus, three or more list items in a row that are links, are marked too."""
    found = blocks(page or "")
    if not hints:
        for b in found:
            b.marked, b.text = False, b.whole
    elif any(b.article and not b.marked for b in found):
        for b in found:
            b.marked |= not b.article
    else:
        run: list[Block] = []
        for b in [*found, None]:
            link = b is not None and b.item and 2 * b.links > len(b.whole)
            if run and not (link and b.path[:-1] == run[-1].path[:-1]):
                if len(run) >= MENU_LINKS:
                    for x in run:
                        x.marked = True
                run = []
            if link:
                run.append(b)
    return found


def _hash(x: str) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def node(path: tuple[str, ...]) -> int:
    return _hash("\x1f".join(path))


def features(found: list[Block]) -> Iterator[tuple[int, list[int], bool, int]]:
    """(node, ancestors, is content, feature), each once a page."""
    texts: dict[tuple[str, ...], set[int]] = {}
    styles: dict[tuple[str, ...], list[str]] = {}
    for b in found:
        texts.setdefault(b.path, set()).add(_hash(b.text))
        for d in range(1, len(b.path)):
            own = styles.setdefault(b.path[:d], [])
            if not own or own[-1] != b.path[d]:
                own.append(b.path[d])
    for path, own in texts.items():
        up = [node(path[:d]) for d in range(1, len(path))]
        styles.setdefault(path, [])
        for f in own:
            yield node(path), up, True, f
    for path, own in styles.items():
        yield node(path), [], False, _hash("\x1f".join(own))


def _host():
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(F.length(host) > 0, host)


def low_importance(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, nodes array<long>): for each host with any, the tree nodes whose branches are furniture by their entropy.

    Pages without a host, and equal pages of a host beyond the first, don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, *f) for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in features(blocks(page))]
            host, own, up, is_content, feature = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(own, pa.int64()), pa.array(up, pa.list_(pa.int64())), pa.array(is_content, pa.bool_()), pa.array(feature, pa.int64())],
                names=["host", "node", "up", "content", "feature"],
            )

    own = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).where("host is not null and html is not null")
    own = own.withColumn("digest", F.sha2("html", 256))
    page = ["host", "digest"]
    copied = materialize(own.groupBy(page).agg(F.count("*").alias("n")).where("n > 1").select(page), "copied")
    # pages without copies stay where they are
    once = own.join(copied, page, "left_anti").unionByName(own.join(copied, page, "left_semi").dropDuplicates(page))
    bound_batches(pages.sparkSession)
    rows = once.select("host", "html").mapInArrow(tidy(run), "host string, node long, up array<long>, content boolean, feature long")
    counts = rows.groupBy("host", "node", "up", "content", "feature").agg(F.count("*").alias("f"))
    nodes = counts.groupBy("host", "node", "content").agg(
        F.max("up").alias("up"), F.sum("f").alias("m"), F.sum(F.col("f") * F.log("f")).alias("flogf"), F.sum(F.log("f")).alias("logf"), F.count("*").alias("l")
    )
    nodes = materialize(nodes, "nodes")
    style = nodes.where(~F.col("content")).select("host", "node", "m", F.when(F.col("m") > 1, 1 - F.col("flogf") / (F.col("m") * F.log("m"))).otherwise(1.0).alias("style"))
    texts = nodes.where("content").select("host", "node", "up", "logf", "l")
    # a node's pages are the sum of its style counts, as each page has one style of it
    leaf = texts.join(style, ["host", "node"]).select(
        "host", "node", "up", "l", "m", F.when(F.col("m") > 1, 1 - F.col("logf") / (F.col("l") * F.log("m"))).otherwise(1.0).alias("importance")
    )
    leaf = leaf.withColumn("importance", F.greatest("importance", F.lit(0.0)))
    below = leaf.select("host", F.explode("up").alias("node"), "l", "importance").groupBy("host", "node").agg((F.sum(F.col("l") * F.col("importance")) / F.sum("l")).alias("below"))
    inner = style.join(below, ["host", "node"]).select("host", "node", "m", ((1 - GAMMA) * F.col("style") + GAMMA * F.col("below")).alias("importance"))
    low = leaf.select("host", "node", "m", "importance").unionByName(inner).where(1 - (1 - F.col("importance")) * F.col("m") / (F.col("m") + 1) < threshold)
    return materialize(low.groupBy("host").agg(F.collect_set("node").alias("nodes")), "furniture")


def main_text(page: str | None, furniture: list[int] | None, threshold: float = THRESHOLD, hints: bool = True) -> str:
    """The page's blocks in branches of enough importance, joined by a line feed.

    ``furniture``: the nodes of low importance on its host; any other node's importance is taken as one. A marked branch's is
    ``HINT`` of that. A heading has the importance of the branch it heads: the same one on many pages is no furniture for that.
    If nothing but headings is left, entropy doesn't count on this page, only hints do.
    """
    found = [b for b in content(page, hints) if not (b.marked and threshold > HINT)]
    if furniture:
        low = set(furniture)
        nodes = {path: {node(path[:d]) for d in range(1, len(path) + 1)} for path in {b.path[: -1 if b.heading else None] for b in found}}
        left = [b for b in found if low.isdisjoint(nodes[b.path[: -1 if b.heading else None]])]
        if not all(b.heading for b in left):
            found = left
    return "\n".join(b.text for b in found)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``.

    Null and empty html give an empty text. Pages with a null or odd url have no host, and are read without site
    statistics. Repeated rows stay. Unclosed tags, comments and quotes end with the page at the latest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, f) for p, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    furniture = low_importance(pages)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    joined = own.join(furniture, "host", "left").select("page_id", "url", "html", "nodes")
    bound_batches(pages.sparkSession)
    return joined.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
