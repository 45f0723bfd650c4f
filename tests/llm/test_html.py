from __future__ import annotations

import random
import re
import time
from xml.etree import ElementTree

import pytest

from textloom.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body>
<nav><ul><li><a href="/x">Home</a></li><li><a href="/y">All the news, every day, for you</a></li></ul></nav>
<div class="sidebar"><p>Buy now, pay later, get one free, and so on and on, for ever and ever.</p></div>
<div id="content"><h1>Heading</h1><p>First paragraph, with commas, and enough words to count for something.</p>
<p>Second paragraph, also long enough, which mentions <a href="z">a link</a> in passing.<p>Third, unclosed, paragraph that goes on for a while.
<script>var t = "<p>no, no, no</p>";</script></div>
<footer>Copyright, all rights reserved, by the owner of this page.</footer></body></html>"""


def test_article_is_found():
    title, text, score, n = H.main_text(PAGE)
    assert title == "A & B"
    assert text.split("\n")[0] == "Heading" and "First paragraph, with" in text and "mentions a link in passing." in text and "Third, unclosed" in text
    assert not any(x in text for x in ("Buy now", "Home", "Copyright", "no, no"))
    assert score > 0 and n == 4


def test_points_of_a_small_page():
    """Worked out by hand: a paragraph of 60 characters with two commas has 3 points."""
    p = "one, two, " + "x" * 50
    _, text, score, n = H.main_text(f"<body><div><p>{p}</p></div></body>")
    assert n == 1 and text == p
    assert score == 5 + 3.0, "the div's own points, and the paragraph's in full"


def test_link_density_discounts():
    p = "one, two, three, four, " + "x" * 30
    links = f"<div class='a'><p><a href='#'>{p}</a></p><p>{'y' * 26}</p></div>"
    plain = f"<div class='b'><p>{p}</p></div>"
    _, text, _, _ = H.main_text(f"<body>{links}<section>{plain}</section></body>")
    assert text == p


def test_good_siblings_are_kept():
    p = "Words, words, words, " * 12
    _, text, _, _ = H.main_text(f"<body><section><div><p>{p}</p><p>{p}</p></div><div><p>{p}</p></div><p>An afterword without any links that runs on beyond eighty characters in all, as it must.</p></section></body>")
    assert text.count("Words, words") >= 3 and "afterword" in text


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<>", "</p>", "plain text", "<p>", "<!-- open", "<script>open", "&#xFFFFFFF; &bogus; &#0;"])
def test_odd_pages(page):
    title, text, score, n = H.main_text(page)
    assert title == "" and score == 0.0 and n == 0
    assert text == ("plain text" if page == "plain text" else text)


@pytest.mark.parametrize("piece", ["<", "<a ", "<div>", '<a href="', "<!--", "<p>a", "</b>", "<table><tr><td>", "<li>x", "&amp;", "a,b "])
def test_time_is_linear(piece):
    begin = time.time()
    H.main_text(piece * (400_000 // len(piece)))
    assert time.time() - begin < 5


def test_table_of_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, "u", PAGE), (2, "u", None), (3, "u", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id bigint, url string, html string, text int, in_0 int")
    got = H.extract(df).collect()
    assert len(got) == 5 and sorted(len(r.text) > 0 for r in got) == [False, False, True, True, True]
    assert H.extract(df.limit(0)).count() == 0


def random_page(rng):
    """A well-formed page of nested containers, paragraphs, lists and links."""
    words = "river, town house mill, and road old report says that, the (water) rose &amp; fell".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n + 1)))
    marks = ["", "", "", ' class="content"', ' id="sidebar"', " class='post related'", ' role="main"']

    def inline(n):
        out = [text(n)]
        for _ in range(rng.randrange(3)):
            tag = rng.choice(["a", "b", "span"])
            out += [f"<{tag}{rng.choice(marks)}>{text(n // 2)}</{tag}>", text(n)]
        return "".join(out)

    def block(depth):
        tag = rng.choice(["p", "p", "p", "blockquote", "ul", "h2", *["div", "section", "article", "nav", "footer"] * (depth > 0)])
        if tag in ("p", "blockquote", "h2"):
            return f"<{tag}{rng.choice(marks)}>{inline(rng.choice([3, 20, 60]))}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{inline(8)}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>"
        return f"<{tag}{rng.choice(marks)}>" + inline(rng.choice([0, 0, 12])) + "".join(block(depth - 1) for _ in range(rng.randrange(4))) + f"</{tag}>"

    return f"<html><head><title>{text(5)}</title></head><body>" + "".join(block(3) for _ in range(rng.randrange(1, 5))) + "</body></html>"


def brute(page):
    """The definition on a tree by another parser, with every sum worked out anew for each element."""
    root = ElementTree.fromstring(page)
    squeeze = lambda t: re.sub(r"\s+", " ", t)
    up = {c: e for e in root.iter() for c in e}
    order = list(root.iter())
    chain = lambda e: [e, *chain(up[e])] if e in up else [e]
    never = lambda e: any(x.tag in H.NEVER for x in chain(e) if x is not root)
    linked = lambda e: any(x.tag == "a" for x in chain(e))

    def own(e):
        """Texts right in e, in order."""
        return [squeeze(t) for t in [e.text, *[c.tail for c in e]] if t]

    def total(e, what):
        return sum(what(x, t) for x in e.iter() for t in own(x) if not never(x))

    length = lambda e: total(e, lambda x, t: len(t.strip()))
    density = lambda e: total(e, lambda x, t: len(t.strip()) * linked(x)) / max(length(e), 1)

    def innate(e):
        if e is root:
            return 0
        values = [v for k, v in e.attrib.items() if k in ("class", "id", "role")]
        return H.TAG_POINTS.get(e.tag, 0) + sum(25 * bool(H.GOOD.search(v)) - 25 * bool(H.BAD.search(v)) for v in values)

    points, paragraphs = {}, 0
    for e in order[1:]:
        direct = sum(len(t.strip()) for t in own(e)) if not never(e) else 0
        if never(e) or length(e) < H.MIN_LENGTH or not (e.tag in H.PARAGRAPH or e.tag in H.OWN_TEXT and direct >= H.MIN_LENGTH):
            continue
        paragraphs += 1
        worth = 1 + total(e, lambda x, t: t.count(",")) + min(length(e) // 100, 3)
        for level, a in enumerate(chain(e)[e.tag in H.PARAGRAPH :][: H.LEVELS]):
            points[a] = points.get(a, innate(a)) + worth / [1, 2, 6, 9, 12][level]
    final = [(points[e] * (1 - density(e)), e) for e in order if e in points and e.tag in H.CONTAINER and not never(e)]
    best = None
    for score, e in final:
        if best is None or score > best[0]:
            best = score, e
    kept = None
    if best:
        kept = {best[1]}
        for e in up.get(best[1], ()):
            if e is best[1] or never(e):
                continue
            if points.get(e, 0) * (1 - density(e)) >= max(H.SIBLING_LEAST, H.SIBLING_SHARE * best[0]) or e.tag == "p" and (length(e) > 80 and density(e) < 0.25 or length(e) > 0 and density(e) == 0 and innate(e) >= 0):
                kept.add(e)
    lines = [""]

    def walk(e):
        if e.tag in H.BLOCK and e is not root:
            lines.append("")
        show = not never(e) and (kept is None or any(x in kept for x in chain(e)))
        if e.text and show:
            lines[-1] += squeeze(e.text)
        for c in e:
            walk(c)
            if c.tail and show:
                lines[-1] += squeeze(c.tail)
        if e.tag in H.BLOCK:
            lines.append("")

    walk(root)
    text = "\n".join(t for t in (squeeze(x).strip() for x in lines) if t)
    title = squeeze("".join(t for e in root.iter("title") for t in own(e))).strip()
    return title, text, round(best[0], 4) if best else 0.0, paragraphs if best else 0


def test_the_query_is_as_brute_force(spark, tmp_path):
    rng = random.Random(3)
    pages = [random_page(rng) for _ in range(150)]
    spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.title, r.text, r.score, r.paragraphs) for r in H.query(spark, str(tmp_path)).collect()}
    assert len(got) == 150 and sum(bool(g[2]) for g in got.values()) > 60
    for i, p in enumerate(pages):
        assert got[i] == brute(p), p


def test_of_equal_scores_the_first_wins():
    p = "Some words, and more words, " * 4
    _, text, _, _ = H.main_text(f"<body><section><div><p>first {p}</p></div></section><section><div><p>other {p}</p></div></section></body>")
    assert text.startswith("first") and "other" not in text
