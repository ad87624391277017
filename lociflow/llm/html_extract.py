"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tags and runs of words.  Words score positive, tags negative,
with weights learned as log odds from labelled pages (LABELLED below); one linear scan
finds the contiguous region with the largest sum.  Elements that hold no article text by
their kind or name (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments) count as one tag each, so one inside the article costs its
weight and is left out, but does not cut the article in two.  The region is widened to
the bounds of the <article> or <main> that holds it.

Defined results: null or empty html, and pages without a word outside such elements,
give an empty text.  Unclosed elements end with the page, if they are raw text; paragraphs,
list items and cells end where the next one or their container's end implies it; other
unclosed containers count as a single tag.  Nothing is cut off, however long.
"""

from __future__ import annotations

import html as _html
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

# fixed values: kinds of HTML elements
RAW = frozenset(["script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title"])
DROPPED = frozenset(["head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "label", "fieldset", "input"]) | RAW
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
INLINE = frozenset(
    ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"]
)
# fixed values: elements whose end tag may be left out, and the tags that end them (any block ends a p)
ENDED_BY = {"p": (), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "tbody", "tfoot"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}
# fixed values: words of class, id and role that mark what is not the article
NAMES = frozenset(
    ["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "masthead", "sidebar", "aside", "widget", "related", "share", "social", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "comment", "comments", "disqus", "replies", "form", "pagination", "pager", "copyright", "legal", "contentinfo", "complementary"]
)

#: Labelled pages: (is article, fragment) in page order; what the weights are learned from.
LABELLED = [
    [(0, "<html><body><div><a href=x>Home</a><a href=y>News</a><a href=z>Sport</a></div>"), (1, "<h1>Rain ends the long dry spell</h1><p>After nine weeks without rain the first storms reached the coast on Monday night.</p><p>Farmers <b>welcomed</b> the change, though the <a href=q>river</a> is still far below its usual level.</p>"), (0, "<div><a href=1>More</a><a href=2>Older stories</a></div><div>Contact us</div></body></html>")],
    [(0, "<html><body><table><tr><td><a href=a>Index</a></td><td><a href=b>Forum</a></td></tr></table>"), (1, "<h2>Sharpening a chisel</h2><p>Flatten the back first, then work the bevel on a coarse stone until a burr can be felt along the edge.<br>Turn it over and take the burr off with light strokes.</p><ul><li>Keep the stone wet at all times</li><li>Check the angle often</li></ul>"), (0, "<table><tr><td>Page 1</td><td><a href=n>Next</a></td></tr></table><ul><li><a href=t>Terms</a></li><li><a href=p>Privacy</a></li></ul></body></html>")],
    [(0, "<html><body><div><span>EN</span><span>DE</span></div><ul><li><a href=k>Shop</a></li><li><a href=m>Cart</a></li></ul><article>"), (1, "<h1>A walk through the old harbour</h1><p>The cranes have stood still since the yard closed, but the slipways are open to visitors.</p><blockquote>It was never quiet here, says a former welder.</blockquote><p>Tours start at ten.</p>"), (0, "</article><div><a href=s>Share</a><a href=f>Print</a></div></body></html>")],
]

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+|\d+")


@lru_cache(1 << 14)
def _marked(attrs: str) -> bool:
    """Does class, id or role name something that is not the article?"""
    for value in _ATTR.findall(attrs):
        for word in value.strip("\"'").lower().split():
            parts = _NAME.findall(word)
            if parts and (parts[0] in NAMES or parts[-1] in NAMES):
                return True
    return False


def _tokens(page: str) -> list[tuple]:
    """('t', text), ('o', name, marked), ('c', name) or ('x', name): an element left out whole."""
    out, at, n = [], 0, len(page)
    find = _TAG.search
    while at < n:
        m = find(page, at)
        if m is None:
            out.append(("t", page[at:]))
            break
        if m.start() > at:
            out.append(("t", page[at : m.start()]))
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            out.append(("c", name))
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            out.append(("x", name))
            at = close.end() if close else n
        else:
            out.append(("o", name, _marked(m[3])))
    return out


def _ends(tokens: list[tuple]) -> dict[int, int]:
    """Opening tag -> last token of its element, whose end tag may be implied."""
    closes: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    loose: list[int] = []  # open elements that may end without a tag, innermost last

    def end_at(i: int):
        j = loose.pop()
        opened[tokens[j][1]].pop()  # j: all open elements of such a kind are loose
        closes[j] = i

    for i, t in enumerate(tokens):
        name = t[1]
        if t[0] == "o" and name not in VOID:
            if name not in INLINE:
                while loose and (name in ENDED_BY.get(tokens[loose[-1]][1], ()) or tokens[loose[-1]][1] == "p"):
                    if any(at and at[-1] > loose[-1] for kind, at in opened.items() if kind not in INLINE):
                        break  # inside a further element
                    end_at(i - 1)
            opened.setdefault(name, []).append(i)
            if name in ENDED_BY:
                loose.append(i)
        elif t[0] == "c" and opened.get(name):
            at = opened[name][-1]
            if name not in INLINE:
                while loose and loose[-1] > at:
                    end_at(i - 1)
            opened[name].pop()
            if loose and loose[-1] == at:
                loose.pop()
            closes[at] = i
    return closes


def _outline(tokens: list[tuple]) -> list[tuple]:
    """tokens with each element that is left out in one ('x', name)."""
    closes = _ends(tokens)
    out, i, inner = [], 0, 0
    while i < len(tokens):
        t = tokens[i]
        if t[0] == "o" and t[1] in ("article", "main"):
            inner += 1
        elif t[0] == "c" and t[1] in ("article", "main"):
            inner -= 1
        boxed = t[0] == "o" and (t[1] in DROPPED or t[1] == "header" and inner <= 0 or t[2] and t[1] not in ("html", "body", "article", "main"))
        if boxed and i in closes:
            out.append(("x", t[1]))
            i = closes[i] + 1
        else:
            out.append(t if not boxed else ("x", t[1]))
            i += 1
    return out


def _learn() -> tuple[dict[str, float], float, float]:
    """(weight per tag, weight of a word, weight of a word in a link) from LABELLED."""
    tags: dict[str, list[int]] = {}
    words = {False: [1, 1], True: [1, 1]}
    for page in LABELLED:
        for main, part in page:
            link = 0
            for t in _outline(_tokens(part)):
                if t[0] == "t":
                    words[link > 0][main] += len(t[1].split())
                else:
                    tags.setdefault(t[1], [1, 1])[main] += 1
                    link += (t[1] == "a") * (1 if t[0] == "o" else -1)
    plain, linked = (math.log(words[k][1] / words[k][0]) for k in (False, True))
    scale = max(plain, 1e-6)
    weight = {k: min(-0.2, math.log(v[1] / v[0]) / scale - 0.2) for k, v in tags.items()}
    return weight, 1.0, max(linked / scale, 0.1)


TAG_WEIGHT, WORD_WEIGHT, LINK_WEIGHT = _learn()
#: Of tags that no labelled page has, and of an element left out whole.
OTHER_TAG, BOX = -0.6, -2.0


def extract(page: str | None) -> str:
    """The page's main text: blocks in page order, one line each."""
    if not page:
        return ""
    tokens = _outline(_tokens(page))
    texts = [" ".join(_html.unescape(t[1]).split()) if t[0] == "t" else "" for t in tokens]
    best = run = 0.0
    lo = hi = start = 0
    link = 0
    has_main = any(t[0] == "o" and t[1] in ("article", "main") for t in tokens)
    inner = 0
    for i, t in enumerate(tokens):
        if t[0] == "t":
            weight = (LINK_WEIGHT if link > 0 else WORD_WEIGHT) * (texts[i].count(" ") + 1 if texts[i] else 0)
            if has_main and inner <= 0:
                weight = -weight / 4
        else:
            weight = BOX if t[0] == "x" else TAG_WEIGHT.get(t[1], OTHER_TAG)
            if t[1] == "a" and t[0] != "x":
                link = max(0, link + (1 if t[0] == "o" else -1))
            elif t[1] in ("article", "main") and t[0] != "x":
                inner += 1 if t[0] == "o" else -1
        if run <= 0:
            run, start = 0.0, i
        run += weight
        if run > best:
            best, lo, hi = run, start, i + 1
    if best <= 0:
        # no region outweighs its tags: all words that are left
        lo, hi = (0, len(tokens)) if any(texts) else (0, 0)
    lo, hi = _widened(tokens, lo, hi)
    blocks: list[str] = []
    words: list[str] = []
    space = True  # white space between inline pieces counts; none where text touches a tag
    for i in range(lo, hi):
        t = tokens[i]
        if t[0] == "t":
            raw = _html.unescape(t[1])
            if texts[i]:
                if not words or space or raw[:1].isspace():
                    words.append(texts[i])
                else:
                    words[-1] += texts[i]
                space = raw[-1:].isspace()
            else:
                space = True
        elif t[1] == "br":
            space = True
        elif t[1] not in INLINE and not (t[0] == "x" and t[1] in RAW):
            if words:
                blocks.append(" ".join(words))
            words, space = [], True
    if words:
        blocks.append(" ".join(words))
    return "\n".join(blocks)


def _widened(tokens: list[tuple], lo: int, hi: int) -> tuple[int, int]:
    """The innermost <article> or <main> around the region, else the region with whole blocks."""
    stack: list[int] = []
    inner = None
    for i, t in enumerate(tokens):
        if t[0] == "x" or t[1] not in ("article", "main"):
            continue
        if t[0] == "o":
            stack.append(i)
        elif stack:
            a = stack.pop()
            if a < hi and lo <= i and (a <= lo + 1 or i >= hi - 1) and (inner is None or i - a < inner[1] - inner[0]):
                inner = (a, i)
    while stack:
        a = stack.pop()
        if a <= lo + 1 and inner is None:
            inner = (a, len(tokens))
    if inner:
        return min(inner[0], lo), max(inner[1], hi)
    while lo > 0 and (tokens[lo - 1][0] == "t" or tokens[lo - 1][1] in INLINE):
        lo -= 1
    while hi < len(tokens) and (tokens[hi][0] == "t" or tokens[hi][1] in INLINE):
        hi += 1
    return lo, hi


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars (code points)."""

    def compute(html):
        text = list(map(extract, html))
        return text, list(map(len, text))

    rows = pages.select(id_col, url_col, F.col(html_col).alias("_html"))
    return map_text(rows, "_html", compute, "text string, n_chars long")
