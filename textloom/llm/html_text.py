"""Main text of HTML pages by scores that paragraphs pass up the tree.

A page becomes a tree of elements. Every paragraph (p, pre, td, blockquote, or
a div, section or article with text of its own) of at least MIN_LENGTH
characters has a point, a point for each comma, and a point for each hundred
characters, up to three. Its parent gets them in full, its grandparent half of
them, and the k-th ancestor above these a 3k-th, up to five levels. Elements
also have points for their tag and for words in their class and id. A
container's score is its points times one less its link density (the share of
its text that is in links). The best container is kept, and of its siblings
those that score at least a fifth of it, and paragraphs of few links.

Within what is kept, script, style, navigation, forms and the like are left
out, blocks become lines, and white space is single. Parsing takes time in
proportion to the page, whatever its markup: unclosed and crossed tags are
closed as browsers do in the common cases, without recursion.

Cases: a null or empty page gives an empty text, no title and score 0.0. A
page without any paragraph that scores gives all of its body's text. Of equal
scores the first in the page wins. Repeated rows, and rows of one id, each give
a row; null ids stay. Very long pages are parsed whole. An empty table gives no
rows. Extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .frames import narrow, per_batch

MIN_LENGTH, LEVELS, SIBLING_SHARE, SIBLING_LEAST = 25, 5, 0.2, 10.0

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^<>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul html head title".split())
CLOSES_P = BLOCK - {"html", "head", "title", "td", "th", "tr", "li", "dd", "dt"}
NEVER = frozenset("nav footer aside form button head title menu dialog label input header".split())
PARAGRAPH = frozenset("p pre td blockquote".split())
CONTAINER = frozenset("div section article main body td blockquote center table tbody tr html figure ul ol dl form span".split())
OWN_TEXT = frozenset("div section article main".split())
SAME = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
TAG_POINTS = {"article": 8, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "form": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5}
GOOD = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
BAD = re.compile(r"\bads?\b|advert|banner|breadcrumb|combx|comment|contact|cookie|footer|masthead|menu|\bnav|pager|popup|promo|related|share|shoutbox|sidebar|social|sponsor|subscribe|widget", re.I)


class Tree:
    """Elements in the order in which they begin. Element 0 is the page."""

    def __init__(self, source: str):
        self.tag, self.parent, self.points = ["html"], [-1], [0]
        #: Texts, breaks (None) and the elements they are in, in the order of the page.
        self.pieces: list[tuple[int, str | None]] = []
        stack, opened, at = [0], {"html": 1}, 0

        def close(stop: int) -> None:
            while len(stack) > stop:
                opened[self.tag[stack.pop()]] -= 1

        def close_last(tags: str, until: frozenset) -> None:
            names = tags.split()
            if not any(opened.get(t) for t in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in names:
                    close(k)
                    return
                if t in until:
                    return

        for m in MARKUP.finditer(source):
            if m.start() > at:
                self.pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                if name in BLOCK:
                    self.pieces.append((stack[-1], None))
                if opened.get(name) and name != "html":
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    close(k)
                continue
            if name == "html":
                continue
            if name in CLOSES_P and opened.get("p"):
                close_last("p", frozenset())
            if name in SAME:
                close_last(SAME[name], frozenset(("ul", "ol", "dl", "table")))
            if name == "body" and opened.get("head"):
                close_last("head", frozenset())
            if name in BLOCK or name == "br":
                self.pieces.append((stack[-1], None))
            if name in VOID or m[4].endswith("/"):
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            points = TAG_POINTS.get(name, 0)
            if m[4]:
                for a in ATTRIBUTE.finditer(m[4]):
                    value = a[1] or a[2] or a[3] or ""
                    points += 25 * bool(GOOD.search(value)) - 25 * bool(BAD.search(value))
            self.points.append(points)
            stack.append(len(self.tag) - 1)
            opened[name] = opened.get(name, 0) + 1
        if at < len(source):
            self.pieces.append((stack[-1], source[at:]))

    def extract(self) -> tuple[str, str, float, int]:
        """Title, text, score of the best container, and how many paragraphs scored."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        never, linked = [False] * n, [False] * n
        for i in range(1, n):
            p = parent[i]
            never[i] = never[p] or tag[i] in NEVER
            linked[i] = linked[p] or tag[i] == "a"
        length, links, commas, own = [0] * n, [0] * n, [0] * n, [0] * n
        title, cleaned = [], []
        for i, text in self.pieces:
            if text is not None:
                text = SPACE.sub(" ", html.unescape(text) if "&" in text else text)
                if tag[i] == "title":
                    title.append(text)
                if never[i]:
                    text = ""
                size = len(text.strip())
                length[i] += size
                own[i] += size
                commas[i] += text.count(",") + text.count("，") + text.count("、")
                if linked[i]:
                    links[i] += size
            cleaned.append((i, text))
        for i in range(n - 1, 0, -1):
            p = parent[i]
            length[p] += length[i]
            links[p] += links[i]
            commas[p] += commas[i]
        points: dict[int, float] = {}
        paragraphs = 0
        for i in range(1, n):
            if never[i] or length[i] < MIN_LENGTH or not (tag[i] in PARAGRAPH or tag[i] in OWN_TEXT and own[i] >= MIN_LENGTH):
                continue
            paragraphs += 1
            worth = 1 + commas[i] + min(length[i] // 100, 3)
            a, level = (parent[i] if tag[i] in PARAGRAPH else i), 0
            while a >= 0 and level < LEVELS:
                if a not in points:
                    points[a] = self.points[a]
                points[a] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                a, level = parent[a], level + 1
        final = {a: s * (1 - links[a] / max(length[a], 1)) for a, s in points.items() if tag[a] in CONTAINER and not never[a]}
        if not final:
            return self._text(cleaned, never, None, "".join(title), 0.0, 0)
        best = max(sorted(final), key=lambda a: final[a])
        kept = {best}
        least = max(SIBLING_LEAST, SIBLING_SHARE * final[best])
        for i in range(1, n):
            if parent[i] != parent[best] or i == best or never[i]:
                continue
            density = links[i] / max(length[i], 1)
            if points.get(i, 0) * (1 - density) >= least or tag[i] == "p" and (length[i] > 80 and density < 0.25 or 0 < length[i] and density == 0 and self.points[i] >= 0):
                kept.add(i)
        return self._text(cleaned, never, kept, "".join(title), final[best], paragraphs)

    def _text(self, cleaned, never, kept, title, score, paragraphs):
        inside = [kept is None] * len(self.tag)
        if kept is not None:
            for i in range(len(self.tag)):
                inside[i] = i in kept or i > 0 and inside[self.parent[i]]
        lines, line = [], []
        for i, text in cleaned:
            if text is None:
                lines.append("".join(line))
                line = []
            elif inside[i] and not never[i]:
                line.append(text)
        lines.append("".join(line))
        tidy = [t for t in (SPACE.sub(" ", x).strip() for x in lines) if t]
        return SPACE.sub(" ", title).strip(), "\n".join(tidy), round(score, 4), paragraphs


def main_text(source: str | None) -> tuple[str, str, float, int]:
    """Title, text, score and number of scored paragraphs of a page."""
    return Tree(source).extract() if source else ("", "", 0.0, 0)


SCHEMA = "page_id bigint, title string, text string, score double, paragraphs int"


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, title, text, score and paragraphs."""

    def make():
        def step(columns):
            found = [main_text(columns[1][i].as_py()) for i in range(len(columns[1]))]
            title, text, score, paragraphs = zip(*found, strict=True)
            yield {"page_id": columns[0], "title": list(title), "text": list(text), "score": np.array(score, np.float64), "paragraphs": np.array(paragraphs, np.int32)}

        return step

    return per_batch(narrow(pages, page_id=id_col, html=html_col), make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
