from __future__ import annotations

import textwrap

import pytest

from textloom.llm import licences as L

LONG = ["mit-grant", "apache-2.0-header", "gpl-header", "isc-grant", "bsd-redistribution", "cc0-notice", "mpl-2.0-notice"]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_licences_are_found(spark, frame, mark):
    rows = []
    for i, name in enumerate(LONG):
        body = textwrap.wrap(L.TEMPLATES[name], 40)
        rows.append((i, "\n".join(["Some head", mark.rstrip(), *(mark + x for x in body), mark.rstrip(), "the rest"])))
    got = {(r.doc_id, r.template): r.block for r in L.scan(frame(rows), paragraphs=True).collect()}
    assert {(i, name) for i, name in enumerate(LONG)} <= set(got)
    assert all(got[i, name] == 2 for i, name in enumerate(LONG))


def test_a_line_that_matches_is_reported_alone(spark, frame):
    text = "a first line\n" + L.TEMPLATES["mit-notice"] + "\nand a last one"
    got = [(r.doc_id, r.block, r.template) for r in L.scan(frame([(1, text), (2, "Released under\n\nthe MIT License."), (3, "the MIT License."), (4, "Released under")]), paragraphs=True).collect()]
    assert got == [(1, 1, "mit-notice")], "paragraphs end at blank lines and with their text"


def test_words_far_apart_in_a_paragraph_are_no_match(spark, frame):
    """All words of a notice, but spread over a long paragraph; and the notice itself amid one."""
    far = "\n".join(f"{w} and some more words that have nothing to do with it" for w in L.TEMPLATES["mit-notice"].split())
    lines = [f"line {i} of prose that goes on" for i in range(6)]
    near = "\n".join([*lines, "Released under", "the MIT License.", *lines])
    got = [(r.doc_id, r.block, r.template, r.overlap) for r in L.scan(frame([(1, far), (2, near)]), paragraphs=True).collect()]
    assert got == [(2, 6, "mit-notice", 5)]


def test_closest_run():
    lines = [["a"], ["x", "b"], ["c"], ["a", "b", "c", "d"]]
    assert L.closest_run(lines, {"a", "b", "c"}, 4) == (3, 0)
    assert L.closest_run(lines, {"a", "b", "c"}, 3) == (2, 0)
    assert L.closest_run(lines, {"a", "b", "c", "d"}, 9) == (4, 3)
    assert L.closest_run([["a"] * 9], {"a"}, 3)[0] == 0
