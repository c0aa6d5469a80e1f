"""Main text of HTML pages: flat text blocks judged by a decision tree.

A page is read once from left to right. Block-level tags cut it into flat
blocks of text; white space in a block becomes one space and character
references are decoded. Each block has its word count and link density (share
of words inside links), those of the block before and the block after it, and
what its enclosing elements say: inside a boilerplate element (menu, footer,
sidebar, advert, form, comments ...), inside the main element, a heading. A
decision tree, grown here on the small labelled table ``LABELLED``, tells
content from the rest. Content blocks are joined by a line feed in page order.

A line break tag is white space, two in a row end a block. Scripts, styles,
titles and text areas are skipped, up to the end of the page if they never
close. Buttons, drawings, players and the like (``EMBEDDED``) are skipped up to
their own end tag; one that has none before an element around it closes, and a
self-closed one, is empty. Class names are weak evidence: those that tell what a
page has, lacks or hides (``has-footer``, ``no-sidebar``) say nothing, and an
element with most words of a page without a main element is no boilerplate by
its class. Inline elements whose class says advert or notice and no more are
blocks of their own. A ``<`` that starts no tag is text. Null and empty pages have an empty text;
repeated rows are each extracted.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: element and class names of HTML pages ---------------------
RAW = ("script", "style", "title", "textarea")
EMBEDDED = frozenset(("noscript", "template", "select", "button", "iframe", "object", "svg", "canvas", "audio", "video"))
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset(("hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"))
ALWAYS_BOILER = frozenset(("nav", "footer", "aside", "menu", "dialog", "search"))
OFTEN_BOILER = frozenset(("form", "header", "fieldset"))
COMMENT_WORDS = frozenset(("comment", "comments", "commentlist", "disqus", "respond", "replies", "reply"))
BOILER_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored
    cookie cookies consent gdpr notice notification alert popup modal overlay nav navbar navigation navbox menu
    breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar newsletter subscribe subscription signup login
    share sharing social related recommended widget pagination pager search copyright legal disclaimer complementary
    contentinfo skip""".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
#: words of a class that tell what its page has, lacks or hides, not what it is
ABOUT_WORDS = frozenset("no not non has with without hide hidden hides show shows off on is enabled disabled left right".split())
INLINE = frozenset("span ins small font b em strong i u mark label".split())
# ------------------------------------------------------------------------------
_RAW = "|".join(RAW)
#: Attributes follow the grammar closely, so a page of unclosed quotes is still read in linear time.
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/<>]*+)(?:"""
    r"""(?P<more>(?:[\s/]++(?:[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'<>]*+))?+)?+)*+)>"""
    r"""|(?P<loose>[^<>]*+)>)|<[!?/][^<>]*+>""", re.I | re.S)
_HINT = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_EMBEDDED = re.compile(rf"<(?:{'|'.join(EMBEDDED)})(?=[\s/>])", re.I)
NONE, MAIN, BOILER, STRONG = range(4)


def _state(before: int, name: str, more: str) -> int:
    """What an element says about the text in it, given what is around it."""
    if before == STRONG or name in ALWAYS_BOILER:
        return STRONG
    said = set()
    if more and name not in ("html", "body"):
        for token in _tokens(more):
            if not ABOUT_WORDS & set(token):
                said.update(token)
    if said & COMMENT_WORDS:
        return STRONG
    if said & BOILER_WORDS or name == "form" or name in OFTEN_BOILER and before != MAIN:
        return MAIN if name in ("article", "main") else BOILER
    if name in ("article", "main") or "role" in more and "main" in said:
        return MAIN
    return MAIN if before == NONE and said & MAIN_WORDS else before


def _tokens(more: str) -> list[list[str]]:
    """The words of each class, id and role of a tag."""
    return [_WORDS.findall(token) for _, a, b, c in _HINT.findall(more) for token in (a or b or c).lower().split()]


def _inline_clutter(more: str) -> bool:
    """Whether an inline element is an advert, notice or the like: one of its classes says that and nothing else."""
    return any(token and set(token) <= BOILER_WORDS for token in _tokens(more))


def _self_closed(m: re.Match) -> bool:
    return (m["more"] or m["loose"] or "").rstrip().endswith("/")


def _embedded(page: str) -> dict[int, int]:
    """Where each embedded element starts, and where its own end tag ends."""
    out: dict[int, int] = {}
    if not _EMBEDDED.search(page):
        return out
    stack: list[tuple[str, int]] = []
    open_names: Counter[str] = Counter()
    for m in _TOKEN.finditer(page):
        name = (m["name"] or "").lower()
        if name not in EMBEDDED and (name not in BLOCK or name in VOID):
            continue
        if not m["end"]:
            if not _self_closed(m):
                stack.append((name, m.start()))
                open_names[name] += 1
            continue
        while open_names[name]:
            top, start = stack.pop()
            open_names[top] -= 1
            if top == name:
                if name in EMBEDDED:
                    out[start] = m.end()
                break
    return out


class Block:
    __slots__ = ("text", "words", "linked", "state", "heading")

    def __init__(self, text, words, linked, state, heading):
        self.text, self.words, self.linked, self.state, self.heading = text, words, linked, state, heading


#: share of a page's words from which on an element is the page, whatever its class says
WHOLE = 2 / 3


def flat_blocks(page: str) -> list[Block]:
    """The blocks of a page. An element that only its class calls boilerplate
    and that holds most words of a page without a main element is taken as
    its body."""
    blocks, held = _blocks(page, frozenset())
    total = sum(b.words for b in blocks)
    if any(b.state == MAIN for b in blocks):
        return blocks
    wrappers = frozenset(at for at, words in held.items() if words > WHOLE * total)
    return _blocks(page, wrappers)[0] if wrappers else blocks


def _blocks(page: str, wrappers: frozenset) -> tuple[list[Block], dict[int, int]]:
    """(blocks, words in each element that its class calls boilerplate, by its place); wrappers are not."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    weak: list[tuple[int, int]] = []  # (depth on the stack, place) of open elements called boilerplate by class
    held: dict[int, int] = {}
    parts: list[str] = []
    links: list[str] = []
    state, in_link, breaks, heading = NONE, 0, 0, False
    open_names: Counter[str] = Counter()

    def close_block():
        nonlocal breaks
        words = "".join(parts).split()
        if words:
            for _, place in weak:
                held[place] = held.get(place, 0) + len(words)
            out.append(Block(" ".join(words), len(words), min(len(" ".join(links).split()), len(words)), state, heading))
        parts.clear()
        links.clear()
        breaks = 0

    def add(raw: str):
        nonlocal breaks
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            links.append(text)
        if breaks and not text.isspace():
            breaks = 0

    at, embedded = 0, _embedded(page)
    for m in _TOKEN.finditer(page):
        if m.start() < at:  # in an embedded element
            continue
        if m.start() > at:
            add(page[at:m.start()])
        at = embedded.get(m.start(), m.end())
        name = m["name"]
        if not name:
            continue
        name, closing = name.lower(), bool(m["end"])
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                close_block()
        elif name in INLINE and (open_names[name] or not closing and m["more"] and _inline_clutter(m["more"])):
            # from an inline advert on, all elements of its name are followed to its end
            close_block()
            if not closing:
                before = stack[-1][1] if stack else NONE
                stack.append((name, STRONG if _inline_clutter(m["more"] or "") else before))
                open_names[name] += 1
            elif any(top == name for top, _ in stack[-1:]):
                open_names[stack.pop()[0]] -= 1
            state = stack[-1][1] if stack else NONE
            heading = bool(stack) and stack[-1][0] in HEADING
        elif name in BLOCK:
            close_block()
            if name in VOID:
                continue
            if closing:
                while open_names[name]:
                    top = stack.pop()[0]
                    open_names[top] -= 1
                    if top == name:
                        break
            else:
                in_link = 0
                if stack and (stack[-1][0] == "p" or stack[-1][0] in HEADING or name == "li" == stack[-1][0]):
                    open_names[stack.pop()[0]] -= 1
                more = m["more"] or m["loose"] or ""
                before = stack[-1][1] if stack else NONE
                if not _self_closed(m):
                    own = _state(before, name, more)
                    if own == BOILER and before < BOILER and name not in OFTEN_BOILER:
                        if m.start() in wrappers:
                            own = before
                        else:
                            weak.append((len(stack), m.start()))
                    stack.append((name, own))
                    open_names[name] += 1
            while weak and weak[-1][0] >= len(stack):
                weak.pop()
            state = stack[-1][1] if stack else NONE
            heading = bool(stack) and stack[-1][0] in HEADING
    if at < len(page):
        add(page[at:])
    close_block()
    return out, held


# Small labelled table: one block a row.
# words, link density, words before, density before, words behind, density behind, in main, in boilerplate, heading
COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "boiler", "heading")
LABELLED = (
    # inside the main element: headings, long and very short paragraphs, quotes, lists with links
    ((9, 0.0, 6, 0.0, 60, 0.0, 1, 0, 1), 1), ((60, 0.0, 9, 0.0, 80, 0.0, 1, 0, 0), 1),
    ((80, 0.1, 60, 0.0, 1, 0.0, 1, 0, 0), 1), ((1, 0.0, 80, 0.1, 2, 0.0, 1, 0, 0), 1),
    ((2, 0.0, 1, 0.0, 0, 0.0, 1, 0, 0), 1), ((1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0), 1),
    ((12, 0.5, 30, 0.0, 11, 0.6, 1, 0, 0), 1), ((5, 1.0, 40, 0.0, 40, 0.0, 1, 0, 0), 1),
    ((200, 0.0, 3, 1.0, 12, 0.0, 1, 0, 0), 1), ((4, 0.0, 2, 1.0, 25, 0.0, 1, 0, 1), 1),
    ((25, 0.0, 4, 0.0, 14, 0.0, 1, 0, 0), 1), ((3, 0.0, 5, 1.0, 3, 0.0, 1, 0, 0), 1),
    # there too, next to link lists
    ((5, 0.0, 30, 0.0, 3, 1.0, 1, 0, 0), 1), ((2, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0), 1),
    ((10, 1.0, 2, 1.0, 2, 1.0, 1, 0, 0), 1), ((1, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0), 1),
    ((8, 0.5, 2, 1.0, 0, 0.0, 1, 0, 0), 1), ((14, 0.0, 3, 1.0, 4, 1.0, 1, 0, 1), 1),
    ((6, 1.0, 8, 1.0, 5, 1.0, 1, 0, 0), 1), ((3, 0.7, 12, 1.0, 1, 0.5, 1, 0, 0), 1),
    # menus, breadcrumbs, link lists
    ((1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), 0),
    ((2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0),
    ((3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((2, 1.0, 1, 1.0, 30, 0.0, 0, 0, 0), 0),
    ((6, 1.0, 120, 0.0, 7, 1.0, 0, 0, 0), 0), ((14, 0.9, 15, 0.8, 12, 1.0, 0, 0, 0), 0),
    # adverts, notices, sidebars, footers, forms and reader comments, short or long
    ((8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), 0), ((40, 0.0, 1, 1.0, 60, 0.0, 0, 1, 0), 0),
    ((25, 0.2, 90, 0.0, 0, 0.0, 0, 1, 0), 0), ((90, 0.0, 50, 0.0, 70, 0.0, 0, 1, 0), 0),
    ((3, 0.0, 20, 0.0, 30, 0.0, 0, 1, 1), 0), ((150, 0.0, 3, 0.0, 0, 0.0, 0, 1, 0), 0),
    ((1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 0), ((12, 0.3, 12, 0.0, 5, 1.0, 0, 1, 0), 0),
    ((18, 0.0, 45, 0.0, 60, 0.0, 0, 1, 0), 0), ((60, 0.0, 70, 0.0, 45, 0.0, 0, 1, 0), 0),
    ((35, 0.0, 8, 0.0, 35, 0.0, 0, 1, 0), 0), ((300, 0.0, 100, 0.0, 100, 0.0, 0, 1, 0), 0),
    ((5, 0.0, 60, 0.0, 60, 0.0, 0, 1, 1), 0), ((22, 0.0, 15, 0.0, 30, 0.0, 0, 1, 0), 0),
    # pages without a main element: paragraphs, their headings, short ones between long ones
    ((45, 0.0, 6, 0.0, 50, 0.0, 0, 0, 0), 1), ((70, 0.05, 45, 0.0, 30, 0.0, 0, 0, 0), 1),
    ((30, 0.1, 70, 0.0, 3, 1.0, 0, 0, 0), 1), ((18, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0), 1),
    ((16, 0.0, 60, 0.0, 2, 0.5, 0, 0, 0), 1), ((7, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1), 1),
    ((4, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1), 1), ((5, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0), 1),
    ((3, 0.0, 60, 0.0, 20, 0.0, 0, 0, 0), 1), ((6, 0.0, 0, 0.0, 25, 0.0, 0, 0, 1), 1),
    ((120, 0.0, 60, 0.0, 90, 0.0, 0, 0, 0), 1), ((300, 0.0, 10, 0.0, 5, 1.0, 0, 0, 0), 1),
    ((95, 0.02, 4, 0.0, 200, 0.0, 0, 0, 0), 1), ((180, 0.1, 95, 0.0, 0, 0.0, 0, 0, 0), 1),
    ((22, 0.25, 24, 0.0, 18, 0.0, 0, 0, 0), 1), ((15, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1),
    # and their clutter: by-lines, copyright lines, tags, captions of link lists
    ((3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), 0), ((4, 0.5, 2, 1.0, 3, 0.0, 0, 0, 0), 0),
    ((6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), 0), ((5, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1), 0),
    ((2, 0.0, 4, 0.5, 6, 1.0, 0, 0, 0), 0), ((7, 0.4, 60, 0.0, 2, 1.0, 0, 0, 0), 0),
    ((20, 0.6, 50, 0.0, 4, 1.0, 0, 0, 0), 0), ((30, 0.7, 3, 1.0, 3, 1.0, 0, 0, 0), 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """Decision tree by Gini impurity: a class, or (feature, limit, at most, above)."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(limit), low
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, limit, low = best
    return f, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained(rows=LABELLED):
    return grow(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows]))


def decide(tree, row) -> bool:
    while not isinstance(tree, int):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return bool(tree)


def features(blocks: list[Block]) -> list[tuple]:
    flat = [(0, 0.0), *((b.words, b.linked / b.words) for b in blocks), (0, 0.0)]
    return [(*flat[i + 1], *flat[i], *flat[i + 2], b.state == MAIN, b.state >= BOILER, b.heading)
            for i, b in enumerate(blocks)]


def main_text(page: str | None, tree) -> str:
    blocks = flat_blocks(page or "")
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if decide(tree, row))


def main_text_column(page: Column, rows=LABELLED) -> Column:
    tree = trained(rows)

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return F.pandas_udf(run, "string")(page)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                         main_text_column(F.col(html_col)).alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))
