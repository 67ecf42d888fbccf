"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' features.

A page is read once into flat blocks of text, each with its word count, its share of words inside links and whether it is a heading, and into the
containers around them. A block's features are these, the word counts and link densities of the blocks before and after it, whether it stands in the page's article
(or one of its articles), and its nearest container that is usually not content, with the share of the page's text under that container. An
article inside such a container is not of it. The tree is grown here (Gini impurity) on the small labelled table below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.llm.common import pieces

FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "place", "aside", "share", "heading")
#: Labelled blocks: the features in the order of FEATURES (link densities and shares in percent), then 1 for main text.
#: place: 1 inside an article, 0 on a page without one, -1 outside the articles of a page that has one.
#: aside: the nearest container that is usually not content: 1 a menu, header, footer, sidebar, notice, advert or form, 2 readers' comments, 0 none.
#: share: the page's words, without those in links, that stand under this container.
EXAMPLES = """
  8   0   1 100  25   0  1 0   0 1 1
  6   0   0   0   9   0  1 0   0 1 1
  5   0   8   0  60   0  1 0   0 0 1
  1   0  40   0  35   0  1 0   0 0 1
 12   0   6   0 120   0  1 0   0 0 1
 80   0  12   0  70   0  1 0   0 0 1
 95   4  80   0  50  10  1 0   0 0 1
 40  20  60   0  90   0  1 0   0 0 1
  9   0 150   0   0   0  1 0   0 0 1
  3 100  50   0  60   0  1 0   0 0 1
 10  60  70   0  80   0  1 0   0 0 1
  2  50   9   0  45   0  1 0   0 0 1
 30   0   0   0   0   0  1 0   0 0 1
  3   0   0   0   0   0  1 0   0 1 1
  4 100   2 100   3 100  1 0   0 0 0
  2 100   4 100   2 100  1 0   0 0 0
  6 100   3 100   5  90  1 0   0 0 0
  3 100  45   0   4 100  1 0   0 0 0
  5 100   3 100   0   0  1 0   0 0 0
  7   0  60   0  12   0  1 1   2 0 0
 30   0  90   0   4 100  1 1   7 0 0
  4 100  80   0   3 100  1 1   2 0 0
 60   0  70   0  55   0  1 1  15 0 0
  3   0  20   0  40   0  1 1   2 1 0
 45  10  30   0   8   0  1 1  11 0 0
  1 100   0   0   1 100 -1 1   2 0 0
  1 100   1 100   8   0 -1 1   2 0 0
  8   0   1 100   7   0 -1 1   2 0 0
 10   0  55   0   0   0 -1 1   2 0 0
 70   0   5   0  60   0 -1 1  17 0 0
  9   0   3 100  10   0 -1 0   0 0 0
 25   0   8   0  30   0 -1 0   0 0 0
 90   0  10   0   0   0 -1 0   0 0 0
  4   0   1 100  12   0 -1 0   0 1 0
  3 100   4 100   2 100 -1 0   0 0 0
  5  80  20   0   6   0 -1 0   0 0 0
  7   0   3 100  30   0  0 0   0 1 1
  5   0  60   0  75   0  0 0   0 1 1
 60   0   7   0  50   0  0 0   0 0 1
 25   0   9   0  80   0  0 0   0 0 1
 45  15  60   0  70   0  0 0   0 0 1
 11   0  45   0  50   0  0 0   0 0 1
  6   0  30   0  40   0  0 0   0 0 1
 14   0   6   0   0   0  0 0   0 0 1
100   5   5   0   4 100  0 0   0 0 1
 18   0   3 100   2 100  0 0   0 0 1
  2   0   9   0  14   0  0 0   0 0 1
  2 100   3 100   2 100  0 0   0 0 0
  4  80   3 100   5 100  0 0   0 0 0
  5 100   0   0   3 100  0 0   0 0 0
  3 100  60   0   2 100  0 0   0 0 0
  6 100   2 100   0   0  0 0   0 0 0
  9  90  12  80  10  90  0 0   0 0 0
  1 100   1 100  20   0  0 1   2 0 0
  8   0   1 100   9   0  0 1   2 0 0
 12   0  70   0   0   0  0 1   3 0 0
 50   0  40   0  60   0  0 1  12 0 0
  3   0   2 100   5   0  0 1   2 1 0
 35  10   9   0  20   0  0 1   8 0 0
 60   0   7   0  55   0  0 1  85 0 1
 45   5  60   0   8   0  0 1  92 0 1
  8   0   0   0  60   0  0 1  85 1 1
 25   0  60   0  40   0  0 1  78 0 1
 70   0  30   0  80   0  1 1  70 0 1
  3 100  60   0   4 100  0 1  85 0 0
  5 100   4 100   3 100  0 1  90 0 0
 30   0  25   0  20   0  0 2  55 0 0
 60   0  12   0  45   0  0 2  75 0 0
 15   0   4   0  30   0  1 2  40 0 0
  2   0  30   0  15   0  0 2  60 1 0
 40   0   9   0  35   0 -1 2  80 0 0
 55   0   9   0  60   0  0 2  98 0 1
 20   0  60   0  30   0  0 2  97 0 1
  3   0   4 100   3 100  0 0   0 0 0
  5   0   3 100   4  90  0 0   0 0 0
  6   0   5  90   3 100  0 0   0 1 0
  4   0  80   0   3 100  0 0   0 1 0
  7   0  60   0   2 100  0 0   0 1 0
  5   0  12 100   6  85  0 0   0 1 0
  2   0   6 100  70   0  0 0   0 0 1
 30   0   4 100   5 100  0 0   0 0 1
 22  10   3 100   3 100  0 0   0 0 1
  6   0  40   0   3 100  0 0   0 0 1
  6   0  40   0   3 100  1 0   0 1 0
  5   0  30   0   4 100  1 0   0 1 0
  7   0  50   0   6 100  1 0   0 0 1
  6   0   4 100  60   0  1 0   0 0 1
 40  55  60   0  50   0  1 0   0 0 1
 45  60  50   0  60   0  0 0   0 0 1
 20  70   5  90   4  90  0 0   0 0 0
 12  75   9  80  10  90  0 0   0 0 0
 12   0  30   0  40   0 -1 0   0 0 0
 40   0  60   0  70   0 -1 0   0 0 0
  6   0  45   0  12   0 -1 0   0 0 0
  3   0   2 100   5   0 -1 0   0 0 0
  8   0  40   0   2 100 -1 0   0 0 0
 55   5   3 100  30   0 -1 0   0 0 0
 15   0  15   0  15   0 -1 0   0 0 0
  4   0  70   0  60   0 -1 0   0 1 0
 30  20   5 100  45   0 -1 0   0 0 0
100   0  80   0  90   0 -1 0   0 0 0
  9   0   0   0   4 100 -1 0   0 0 0
 35   0  12   0  18   0 -1 0   0 0 0
 10   0  45   0  40   0 -1 1  10 0 0
 25   0   3 100  12   0 -1 1   8 0 0
 50   0  40   0  60   0 -1 2  40 0 0
 14   0   4   0  30   0 -1 2  25 0 0
 10   0  60   0  55   0  1 1   3 0 0
 25   0   4 100  70   0  1 1   6 0 0
  2   0  80   0  12   0  1 1   4 1 0
 90   0  40   0  35   0  1 1  15 0 0
 12   0  10   0   9   0  1 1  20 0 0
 40   0  25   0  30   0  1 2  45 0 0
 18   0   5   0  60   0  1 2  30 0 0
 12   0  50   0  60   0  0 1   4 0 0
 30   0  60   0  10   0  0 1   9 0 0
 80   0  30   0  45   0  0 1  25 0 0
  4   0  90   0  20   0  0 1   6 1 0
  9   0   8   0   7   0  0 1  12 0 0
 60   0  45   0  30   0  0 1  40 0 0
 22   0   6   0  40   0  0 2  35 0 0
 70   0  20   0  50   0  0 2  65 0 0
  9   0  60   0  20   0  0 2  50 0 0
 50   0  40   0  60   0  0 1  88 0 1
 30   0  50   0  10   0  0 1  95 0 1
  6   0   0   0  80   0  0 1  90 1 1
 65  10  50   0  70   0  1 1  80 0 1
 20   0  15   0  25   0  1 0   0 0 1
  8   0   9   0   7   0  1 0   0 0 1
 15   0  12 100  40   0  1 0   0 0 1
  2   0  15   0  18   0  1 0   0 0 1
  4   0   3 100   2 100  1 0   0 0 1
 55  10  70   0   4 100  1 0   0 0 1
 12   0  15   0  20   0  0 0   0 0 1
 14   0  30   0  12   0  0 0   0 0 1
  9   0  20   0  16   0  0 0   0 0 1
 18   0   0   0  20   0  0 0   0 0 1
 40   0  16   0   0   0  0 0   0 0 1
  4   0  18   0  15   0  0 0   0 0 1
  3   0  12   0  10   0  0 0   0 1 1
 16   0   4 100  22   0  0 0   0 0 1
  6   0   2 100   5 100  0 0   0 0 0
  7   0   6 100   9 100  0 0   0 0 0
  4   0   4 100   2 100  0 0   0 1 0
  9   0   2 100   3 100  0 0   0 0 0
  2   0   3 100   3 100  0 0   0 0 0
  8   0   0   0   3  70  1 0   0 1 1
  7   0   1 100   2 100  1 0   0 1 1
  6   0   5 100   3  60  1 0   0 1 1
  9   0   0   0   2  50  1 0   0 1 1
  5   0   2 100   4  80  1 0   0 1 1
 10   0   0   0   3 100  0 0   0 1 1
  8   0   3 100   4  60  0 0   0 1 1
  3   0  25   0   3 100  1 0   0 1 0
  4   0  60   0   5 100  1 0   0 1 0
  3  67  10   0   0   0  0 0   0 0 0
  3 100  20   0   0   0  0 0   0 0 0
  2 100   8   0   0   0  0 0   0 0 0
  4 100  40   0   0   0  0 0   0 0 0
  3 100   0   0   6   0  0 0   0 0 0
  4 100   0   0   8   0  0 0   0 0 0
  2 100   0   0  25   0  0 0   0 0 0
  1 100   2 100   5   0  0 0   0 0 0
  1 100   2 100   0   0  1 0   0 0 0
  2 100   1 100   0   0  1 0   0 0 0
  3 100   4 100  40   0  1 0   0 0 0
  4 100  30   0  35   0  0 0   0 0 1
  2 100  20   0  25   0  1 0   0 0 1
  3 100  12   0  15   0  1 0   0 0 1
 20   0   1   0   1   0  1 2  80 0 0
 19   0   1   0   1   0  0 2  85 0 0
 30   0  20   0  25   0  0 2  90 0 0
  2   0  60   0   1   0  1 2  82 1 0
 80   0  20   0  25   0  0 2  88 0 0
  1   0  19   0  19   0  1 2  79 0 0
  1   0  30   0  19   0  0 2  91 0 0
  5   0   4 100  22   0  0 1  96 1 1
  3   0  30   0  20   0  0 1  93 0 1
  8   0  20   0   0   0  0 1  97 0 1
 12   0   9   0  15   0  0 1  90 0 1
  4 100  20   0   3 100  0 1  95 0 0
  2 100   0   0   2 100  0 1  96 0 0
  6   0   0   0  70   0  1 1  85 1 1
 18   0   3 100   2 100  1 0   0 0 1
  3  67   5   0  22   0  1 0   0 0 1
  4  65   8   0  30   0  1 0   0 0 1
  2 100   7   0  40   0  1 0   0 0 1
  3 100   6   0  18   0  1 0   0 0 1
  3  80   8   0  35   0  0 0   0 0 1
  2 100   3 100  30   0  1 0   0 0 0
  3 100   2 100  28   0  0 0   0 0 0
"""

#: Fixed names of the HTML standard, by what they do here. The text of RAW elements is no markup; that of HIDDEN elements is not shown or not prose.
RAW = ("script", "style", "iframe", "noembed", "noframes", "textarea", "title", "xmp")
HIDDEN = ("noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "datalist")
ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ARTICLE_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end when an element of the same list opens.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a class, an id or a role calls a container that is usually not content: its last part (or its only one), and readers' comments.
ASIDE_WORDS = set(
    """ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion
    sidebar sidebars aside widget widgets rail nav navbar navigation menu menus breadcrumb breadcrumbs toolbar topbar masthead header footer
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall newsletter subscribe subscription signup login search searchform
    share sharing social related recommended recommendations trending pagination pager copyright disclaimer complementary contentinfo form skip""".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond responses discussion feedback".split())
#: Parts that say how a container is built, not what it holds; and parts that say it holds, or lacks, what another part names.
BUILD_WORDS = set("section list box container wrapper wrap block area panel inner outer button buttons bar link links item items group row column col holder module region zone slot unit top bottom left right body content text message policy posts articles stories news media icons title heading".split())
WRAPPER_WORDS = set("with has have no without is not hide show page layout site js theme".split())
_VALUE = r"(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*)"
_TAG = re.compile(rf"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<decl>[!?][^>]*(?:>|\Z))|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/=]|[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z))", re.S)
_ATTR = re.compile(rf"([^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?+", re.S)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _called(name: str) -> int:
    """0, or what a container of this class, id or role is: 1 beside the content, 2 readers' comments."""
    parts = _PARTS.findall(_CAMEL.sub("-", name).lower())
    if not WRAPPER_WORDS.isdisjoint(parts):
        return 0
    if {"post", "entry", "article", "story"} & set(parts) and {"header", "title"} & set(parts):
        return 0
    while len(parts) > 1 and parts[-1] in BUILD_WORDS:
        parts.pop()
    return 2 if parts and parts[-1] in COMMENT_WORDS else int(bool(parts) and parts[-1] in ASIDE_WORDS)


@lru_cache(4096)
def _marked(name: str, attrs: str) -> int:
    """What the container that an opening tag starts is: 0, 1 or 2 as in the table, or 3 for one that is not shown."""
    out = int(name in ASIDE_TAGS)
    for key, value in _ATTR.findall(attrs):
        key = key.lower()
        if value[:1] in ("'", '"'):
            value = value[1:-1] if value[-1:] == value[:1] and len(value) > 1 else value[1:]
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _UNSEEN.search(value):
            return 3
        if key in ("class", "id", "role"):
            out = max([out, *map(_called, value.split())])
    return out


def _end_of(page: str, name: str, at: int) -> int:
    """Where an element ends whose opening tag ends at `at`; `at` itself if it is never closed, or opens again where it cannot, and is no raw text."""
    deep = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).finditer(page, at):
        if m[1]:
            deep -= 1
        elif name in RAW:
            continue
        elif name in ("button", "select"):
            return at
        else:
            deep += 1
        if not deep:
            return m.end()
    return len(page) if name in RAW else at


class Page:
    """Flat text blocks of a page and the containers around them."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.rows: list[tuple[int, int, int, int]] = []  # words, words in links, heading, container
        self.parent, self.mark, self.article = [-1], [0], [False]  # of each container; the first is the page
        self._read(page)

    def _open(self, parent: int, mark: int, article: bool) -> int:
        self.parent.append(parent), self.mark.append(mark), self.article.append(article)
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # open block elements and their containers
        articles = heading = linked = in_link = 0
        text: list[str] = []

        def flush() -> None:
            nonlocal linked
            words = "".join(text).split()
            if words:
                self.texts.append(" ".join(words))
                self.rows.append((len(words), min(linked, len(words)), int(heading > 0), stack[-1][1] if stack else 0))
            text.clear()
            linked = 0

        def close(to: int) -> None:
            nonlocal articles, heading, in_link
            while len(stack) > to:
                name, _ = stack.pop()
                articles -= name in ARTICLE_TAGS
                heading -= name in HEADINGS
            in_link = 0

        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            stop = m.start() if m else end
            if stop > at:
                piece = html.unescape(page[at:stop])
                text.append(piece)
                if in_link:
                    linked += len(piece.split())
            if not m:
                break
            at, name, closing = m.end(), (m["name"] or "").lower(), m["close"] == "/"
            if not name:
                continue
            mark = 0 if closing else _marked(name, m["attrs"])
            if name in RAW or name in HIDDEN:
                if not closing and not m["attrs"].endswith("/"):
                    at = _end_of(page, name, at)
                if name not in ("math", "svg"):
                    text.append(" ")
            elif mark == 3 and name not in VOID and name not in ("html", "body") and (over := _end_of(page, name, at)) > at:
                flush()
                at = over
            elif name == "a":
                in_link = int(not closing)
            elif name in INLINE and not mark:
                if closing and any(tag == name for tag, _ in stack[-2:]):  # an inline element that was opened as a container
                    flush()
                    close(max(i for i, (tag, _) in enumerate(stack) if tag == name))
            elif name in VOID:
                if name == "hr":
                    flush()
                else:
                    text.append(" ")
            elif closing:
                flush()
                there = [i for i, (tag, _) in enumerate(stack) if tag == name]
                if there:
                    close(there[-1])
            else:
                flush()
                if stack and stack[-1][0] == "p":  # an open paragraph ends where a block begins
                    close(len(stack) - 1)
                if name in ENDS and stack and stack[-1][0] in ENDS[name]:
                    close(len(stack) - 1)
                if name in ("html", "body"):
                    mark = 0
                elif name == "header":  # the header of an article holds its title; any other header is not content
                    mark = max(mark, int(not articles))
                if articles and mark == 1 and name not in ASIDE_TAGS and any("header" in part for part in m["attrs"].lower().split()):
                    mark = 0
                here = stack[-1][1] if stack else 0
                stack.append((name, self._open(here, mark, name in ARTICLE_TAGS) if mark or name in ARTICLE_TAGS else here))
                articles += name in ARTICLE_TAGS
                heading += name in HEADINGS
        flush()

    def features(self) -> np.ndarray:
        """One row of FEATURES for each block."""
        if not self.rows:
            return np.zeros((0, len(FEATURES)))
        words, linked, heading, place = (np.array(x) for x in zip(*self.rows))
        under = np.bincount(place, words - linked, len(self.parent))
        for c in range(len(self.parent) - 1, 0, -1):  # a container comes after the one around it
            under[self.parent[c]] += under[c]
        beside, inside = [-1], [-1]  # nearest container beside the content, none beyond an article; nearest article
        for c in range(1, len(self.parent)):
            beside.append(c if self.mark[c] else -1 if self.article[c] else beside[self.parent[c]])
            inside.append(c if self.article[c] else inside[self.parent[c]])
        beside, inside = np.array(beside), np.array(inside)
        plain = sum((words - linked)[beside[place] < 0])
        real = [c for c in range(1, len(self.parent)) if self.article[c] and beside[c] < 0]
        most = max((under[c] for c in real), default=0)
        most = most if 20 * most >= 3 * plain else 0  # an article with hardly any text is none
        of_page = np.zeros(len(self.parent), bool)
        for c in real:
            of_page[c] = 5 * under[c] >= most > 0
        where = np.where(of_page[inside[place]] & (inside[place] >= 0), 1.0, -1.0 if most else 0.0)
        aside = np.array(self.mark)[beside[place]] * (beside[place] >= 0)
        share = np.where(aside > 0, 100 * under[beside[place]] / max(1, under[0]), 0)
        link = 100 * linked / words
        before = lambda x: np.concatenate(([0.0], x[:-1]))
        after = lambda x: np.concatenate((x[1:], [0.0]))
        return np.stack((words, link, before(words), before(link), after(words), after(link), where, np.minimum(aside, 2), share, heading), 1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple:
    """A binary tree: (feature, threshold, tree for <=, tree for >) or (label,). Ties go to the first feature and the lowest threshold."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return (int(2 * y.sum() >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            p, q = y[left].mean(), y[~left].mean()
            cost = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), left)
    if best is None:
        return (int(2 * y.sum() >= len(y)),)
    _, f, t, left = best
    return (f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Label of each row of x."""
    if len(tree) == 1:
        return np.full(len(x), bool(tree[0]))
    f, t, low, high = tree
    out, left = np.zeros(len(x), bool), x[:, f] <= t
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


def train(examples: str = EXAMPLES) -> tuple:
    rows = np.array([line.split() for line in examples.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1].astype(int))


def main_text(pages: list[str], tree: tuple) -> list[str]:
    """The main text of each page: its blocks in page order, joined by two line feeds."""
    found = [Page(p) for p in pages]
    keep = decide(tree, np.concatenate([p.features() for p in found])) if found else np.zeros(0, bool)
    out, at = [], 0
    for p in found:
        out.append("\n\n".join(t for t, k in zip(p.texts, keep[at : at + len(p.texts)]) if k))
        at += len(p.texts)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages, from its whole html.

    A null or empty html, and one without main text, gives an empty text and 0. White space inside a block, and a line break element, become one
    space. Markup that is cut off or never closed is read as far as it goes; an element that is not shown and never closed hides nothing. Repeated rows come back repeated; only page_id, url
    and html are read; null ids and urls are kept. An empty table gives an empty table.
    """
    tree = train()
    body = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            got = main_text([h or "" for h in b.column("html").to_pylist()], tree)
            yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(got, pa.string()), "n_chars": pa.array([len(t) for t in got], pa.int64())})

    kinds = dict(body.dtypes)
    return body.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
