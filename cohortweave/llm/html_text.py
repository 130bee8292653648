"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into blocks at block-level tags. Every block is described by its words and link density,
those of its neighbours, and where it stands. The tree is trained on LABELLED when the query is built.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "hinted",
            "article", "heading")

# A small table labelled by hand (own examples): FEATURES, then 1 for main text. `links` is the share of
# words inside links; aside: in nav, header, footer, aside or form; hinted: in a container named like one;
# article: in article or main, or in a container named like the content.
LABELLED = (
    # titles, paragraphs, lists and captions of articles
    (9, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1, 1, 1), (3, 0.0, 6, 1.0, 1, 0.0, 0, 0, 1, 1, 1), (1, 0.0, 9, 0.0, 4, 0.0, 0, 0, 1, 0, 1),
    (4, 0.0, 120, 0.0, 90, 0.1, 0, 0, 1, 0, 1), (45, 0.1, 7, 0.0, 80, 0.0, 0, 0, 1, 0, 1), (210, 0.0, 30, 0.0, 2, 0.0, 0, 0, 1, 0, 1),
    (12, 0.3, 40, 0.0, 40, 0.2, 0, 0, 1, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1, 0, 1), (6, 0.0, 300, 0.0, 12, 0.8, 0, 0, 1, 0, 1),
    (700, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 1), (18, 0.45, 50, 0.1, 60, 0.0, 0, 0, 1, 0, 1), (5, 0.2, 3, 0.0, 80, 0.0, 0, 0, 1, 1, 1),
    (1, 0.0, 5, 1.0, 6, 0.2, 0, 0, 1, 0, 1), (30, 0.0, 8, 0.0, 9, 0.1, 0, 0, 1, 0, 1), (8, 0.0, 1, 1.0, 30, 0.0, 0, 0, 1, 0, 1),
    # the same on pages that do not mark their article
    (80, 0.0, 8, 0.0, 75, 0.0, 0, 0, 0, 0, 1), (33, 0.1, 60, 0.0, 41, 0.0, 0, 0, 0, 0, 1), (150, 0.0, 2, 1.0, 90, 0.0, 0, 0, 0, 0, 1),
    (24, 0.2, 90, 0.0, 6, 1.0, 0, 0, 0, 0, 1), (55, 0.0, 5, 0.9, 3, 1.0, 0, 0, 0, 0, 1), (8, 0.0, 4, 1.0, 64, 0.0, 0, 0, 0, 1, 1),
    (7, 0.0, 70, 0.0, 52, 0.1, 0, 0, 0, 0, 1), (3, 0.0, 95, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (11, 0.0, 45, 0.0, 88, 0.0, 0, 0, 0, 1, 1),
    (400, 0.0, 0, 0.0, 5, 1.0, 0, 0, 0, 0, 1), (28, 0.0, 33, 0.0, 12, 0.5, 0, 0, 0, 0, 1), (21, 0.0, 9, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    # link lists and teasers inside articles
    (6, 1.0, 90, 0.0, 7, 1.0, 0, 0, 1, 0, 0), (3, 1.0, 4, 1.0, 3, 1.0, 0, 0, 1, 0, 0), (14, 0.9, 3, 0.0, 11, 1.0, 0, 0, 1, 0, 0),
    (9, 0.8, 50, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (2, 1.0, 60, 0.0, 60, 0.0, 0, 0, 1, 0, 0),
    # menus, page headers, footers, sidebars and forms
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0, 0), (9, 0.1, 70, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (14, 0.0, 4, 1.0, 5, 1.0, 1, 0, 0, 0, 0), (40, 0.2, 9, 0.5, 30, 0.0, 1, 0, 0, 0, 0), (65, 0.0, 80, 0.0, 6, 0.0, 1, 0, 1, 0, 0),
    (5, 0.0, 3, 1.0, 70, 0.0, 1, 0, 0, 1, 0), (3, 0.0, 120, 0.0, 6, 1.0, 1, 0, 1, 1, 0), (120, 0.0, 4, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (2, 0.0, 60, 0.0, 2, 0.0, 1, 0, 1, 0, 0), (7, 0.0, 2, 0.0, 3, 0.0, 1, 1, 0, 0, 0),
    # adverts, notices, comments and teasers in containers named so
    (8, 0.0, 6, 1.0, 9, 0.0, 0, 1, 0, 0, 0), (35, 0.0, 5, 1.0, 60, 0.0, 0, 1, 0, 0, 0), (22, 0.1, 90, 0.0, 40, 0.0, 0, 1, 1, 0, 0),
    (70, 0.0, 110, 0.0, 55, 0.0, 0, 1, 1, 0, 0), (4, 0.0, 150, 0.0, 30, 0.0, 0, 1, 1, 1, 0), (150, 0.0, 12, 0.0, 60, 0.0, 0, 1, 0, 0, 0),
    (12, 0.5, 30, 0.0, 30, 0.0, 0, 1, 1, 0, 0), (1, 0.0, 80, 0.0, 80, 0.0, 0, 1, 1, 0, 0), (260, 0.0, 90, 0.0, 0, 0.0, 0, 1, 1, 0, 0),
    (18, 0.0, 0, 0.0, 3, 1.0, 0, 1, 0, 0, 0),
    # the same without any mark
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (5, 0.9, 80, 0.0, 6, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (6, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (9, 0.2, 4, 0.8, 5, 0.0, 0, 0, 0, 0, 0), (7, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (25, 0.8, 3, 1.0, 22, 0.9, 0, 0, 0, 0, 0), (45, 0.7, 6, 1.0, 30, 0.8, 0, 0, 0, 0, 0), (4, 0.0, 5, 1.0, 8, 1.0, 0, 0, 0, 1, 0),
    (8, 0.0, 6, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (13, 0.5, 9, 1.0, 7, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
)

ASIDE = frozenset("nav footer aside menu dialog".split())  # and a form that is not around the page
DROPPED = frozenset("head title script style template svg math iframe object canvas audio video textarea select option "
                    "optgroup datalist button noscript label legend fieldset".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noscript")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img br input ruby rt rp picture source map area".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent dialog disqus discussion footer form forms gdpr hidden login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification alert overlay pager pagination popup promo promotion related "
    "recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags "
    "teaser toc toolbar tracking widget widgets complementary contentinfo header response responses feedback".split())
CONTENT = frozenset("article content entry main post story".split())
# parts that hold texts of their own: an article or entry inside one is a comment, advert or teaser
ITEMS = frozenset(
    "ad ads advert adverts advertisement advertising adsense comment comments commentlist discussion disqus related "
    "recommended replies reply respond response responses feedback promo promotion sponsor sponsored teaser hidden".split())
FORMS = frozenset(("form", "forms"))
# compound names that begin or end so say something about a part without naming it
MODIFIERS = frozenset("has with without no not tag category layout".split())
STATES = frozenset("enabled disabled".split())
LANDMARKS = frozenset("nav header footer main article".split())
PAGE_FORM_WORDS = 50
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>)", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: int
    hinted: int
    article: int
    heading: int
    form: int = -1  # place of the form around it


def marks_of(tag: str, attributes: str) -> tuple[int, int, int]:
    """How firmly an element names a side part (0 to 3), and whether it names content and the page's main part.

    1: part of a compound name, which an article, main or content name inside resets; 2: the whole name or
    one of ITEMS, which only the main part resets; 3: unseen, which nothing resets.
    """
    level, named, tagged, main = 0, False, tag in ("article", "main"), tag == "main"
    if attributes and ("=" in attributes or "hidden" in attributes):
        names = []
        for m in NAMED.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            main = main or m[1].lower() == "role" and value.strip().lower() == "main"
            names += [[w.lower() for w in WORD.findall(x)] for x in value.split()]
        names = [set(x) for x in names if x and not (len(x) > 1 and (x[0] in MODIFIERS or x[-1] in STATES))]
        named = any(x & CONTENT and not x & HINTS for x in names)
        for x in names:
            side = x & HINTS - (FORMS if tag == "form" else frozenset())
            items, firm = bool(side & ITEMS), x <= HINTS and not side <= FORMS
            if side and not (named and tagged and not items if firm else named or tagged and not items):
                level = max(level, 2 if firm or items else 1)
        if UNSEEN.search(attributes):
            level = 3
    return level, int(not level and (named or tagged)), int(not level and main)


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty text blocks in page order, white space inside a block as one space.

    Scripts, styles, controls and other parts without running text are dropped. Unclosed tags end with
    the element around them.
    """
    out: list[Block] = []
    # name, dropped, aside, hinted (a level of marks_of), article, form, each including outer ones
    stack: list[tuple[str, int, int, int, int, int]] = []
    page_forms: list[bool] = []  # of each form, whether it is around the page rather than part of it
    parts: list[str] = []
    linked = in_link = heading = 0

    def flush() -> None:
        nonlocal parts, linked, in_link, heading
        words = "".join(parts).split()
        if words:
            _, _, aside, hinted, article, form = stack[-1] if stack else ("", 0, 0, 0, 0, -1)
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), aside, int(hinted > 0), article,
                             heading, form))
        parts, linked, in_link, heading = [], 0, 0, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][1]):
            said = html.unescape(raw) if "&" in raw else raw
            parts.append(said)
            if in_link:
                linked += len(said.split())

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:-3], quote=False))
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3] or m[4] or ""
        if name in INLINE and not (name not in VOID and name != "a" and attributes and UNSEEN.search(attributes)):
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                parts.append(" ")
            if name in INLINE and not closing or not any(s[0] == name for s in stack):
                continue
        if closing:
            if any(s[0] == name for s in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
            elif name not in INLINE:
                flush()
            continue
        flush()
        if name in RAW:
            closed = RAW[name].search(page, at)
            at = closed.end() if closed else end
            continue
        if name == "body":
            stack.clear()
        if name in VOID or attributes.endswith("/") and name in DROPPED:
            continue
        if stack and stack[-1][0] == "p" or stack and name == "li" and stack[-1][0] == "li":
            stack.pop()
        _, dropped, aside, hinted, article, form = stack[-1] if stack else ("", 0, 0, 0, 0, -1)
        own_hint, own_content, own_main = (0, 0, 0) if name in ("body", "html") else marks_of(name, attributes)
        if form >= 0 and name in LANDMARKS:
            page_forms[form] = True
        if own_content and hinted < 2 or own_main and hinted < 3:
            hinted, form = 0, -1
        if name == "form":
            form = len(page_forms)
            page_forms.append(False)
        stack.append((name, dropped or int(name in DROPPED),
                      aside or int(name in ASIDE or name == "header" and not article), max(hinted, own_hint),
                      article or own_content or int(name in ("article", "main")), form))
        if name in HEADINGS:
            heading = 1
    flush()
    inside = Counter()
    for b in out:
        inside[b.form] += b.words
    total = sum(inside.values())
    for b in out:
        around = b.form >= 0 and (page_forms[b.form] or inside[b.form] >= PAGE_FORM_WORDS and 2 * inside[b.form] > total)
        b.aside = b.aside or int(b.form >= 0 and not around)
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    """FEATURES of each block; a missing neighbour has no words and no links."""
    words = np.array([0, *[b.words for b in blocks], 0], float)
    links = np.array([0, *[b.linked for b in blocks], 0], float) / np.maximum(words, 1)
    rest = np.array([(b.aside, b.hinted, b.article, b.heading) for b in blocks], float).reshape(-1, 4)
    sides = [words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]]
    return np.column_stack([*sides, rest])


def train_tree(table: np.ndarray, least: int = 1, depth: int = 8) -> list[tuple]:
    """Gini tree as a list of nodes (feature, threshold, left, right) or (label,); node 0 is the root.

    Ties go to the first feature and the smallest threshold.
    """
    nodes: list[tuple] = []

    def impurity(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p) * len(y)

    def grow(rows: np.ndarray, left: int) -> int:
        at, y = len(nodes), rows[:, -1]
        nodes.append((int(y.mean() * 2 >= 1),))
        best = (impurity(y) - 1e-9, None, None)
        if left and 0 < y.mean() < 1:
            for f in range(rows.shape[1] - 1):
                values = np.unique(rows[:, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    below = rows[:, f] <= cut
                    if least <= below.sum() <= len(y) - least:
                        cost = impurity(y[below]) + impurity(y[~below])
                        if cost < best[0] - 1e-12:
                            best = (cost, f, float(cut))
        if best[1] is not None:
            below = rows[:, best[1]] <= best[2]
            a = grow(rows[below], left - 1)
            nodes[at] = (best[1], best[2], a, grow(rows[~below], left - 1))
        return at

    grow(np.asarray(table, float), depth)
    return nodes


def classify(nodes: list[tuple], rows: np.ndarray) -> list[int]:
    out = []
    for row in rows.tolist():
        node = nodes[0]
        while len(node) > 1:
            node = nodes[node[2] if row[node[0]] <= node[1] else node[3]]
        out.append(node[0])
    return out


def main_text(page: str, nodes: list[tuple]) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, classify(nodes, features_of(blocks))) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            labelled: tuple = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page's main text.

    Null or empty html, and pages without main text, give an empty text. Null ids and urls stay null;
    repeated rows are pages like others. An empty table gives no rows. Other columns are not read.
    """
    nodes = train_tree(np.array(labelled))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                texts = [main_text(p, nodes) if p else "" for p in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                                  pa.array(map(len, texts), pa.int64())], schema=schema)

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
