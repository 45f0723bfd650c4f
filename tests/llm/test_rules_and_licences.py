from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from textloom.llm import licences as L
from textloom.llm import quality_rules as Q

TOKEN = re.compile("[A-Za-z0-9\x80-\U0010ffff]+|[!-/:-@\\[-`{-~]+")


def scores(rows, trusted, buckets):
    """The definition, token by token."""

    def grams(t):
        h = []
        for w in TOKEN.findall(t or ""):
            v = 0
            for c in w:
                v = (v * Q.BASE + ord(c)) % Q.PRIME
            h.append(v)
        return [x % buckets for x in h] + [(a * Q.PAIR + b) % Q.PRIME % buckets for a, b in zip(h, h[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and i in trusted:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] * n / m + Q.PSEUDO) / (raw[b] + Q.PSEUDO))
    return [(i, round(sum(map(ratio, g)) / len(g), 6) if g else 0.0, len(g)) for i, t in rows for g in [grams(t)]]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("buckets", [16, 4096])
def test_scores_are_those_of_the_definition(spark, clashing, awkward, buckets):
    trusted = spark.createDataFrame([(6,), (6,), (7,), (None,), (77,)], "x bigint")
    got = [(r.doc_id, r.score, r.n_grams) for r in Q.score_documents(clashing(awkward), trusted, buckets=buckets).collect()]
    want = key(scores(awkward, {6, 7}, buckets))
    assert [(a, c) for a, _, c in key(got)] == [(a, c) for a, _, c in want]
    assert [b for _, b, _ in key(got)] == pytest.approx([b for _, b, _ in want], abs=2e-6)


def test_a_shuffled_join_gives_the_same(spark, frame, awkward, monkeypatch):
    trusted = spark.createDataFrame([(6,), (7,)], "x bigint")
    a = key((r.doc_id, r.score) for r in Q.score_documents(frame(awkward), trusted).collect())
    monkeypatch.setattr(Q, "broadcast_checked", lambda ids: ids)
    assert key((r.doc_id, r.score) for r in Q.score_documents(frame(awkward), trusted).collect()) == a


def test_foreign_texts_are_rejected(spark, frame):
    good = [(i, f"the report of day {i} says that the river rose and the town was safe") for i in range(60)]
    junk = [(100 + i, "$$$ WIN!! cash!!! now### " * 5) for i in range(20)]
    docs = frame([*good, *junk, (200, None), (201, " ")])
    kept = Q.keep_documents(docs, spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id bigint"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(60))


def test_no_trusted_documents_and_no_documents(spark, frame):
    nobody = spark.createDataFrame([], "doc_id bigint")
    assert [(r.score, r.keep) for r in Q.score_documents(frame([(1, "a b c")]), nobody).collect()] == [(0.0, True)]
    assert Q.score_documents(frame([]), nobody).count() == 0


def brute(rows, templates, threshold):
    out = []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            have = set(re.findall("[a-z0-9]+", line.lower()))
            for name, body in templates.items():
                want = set(re.findall("[a-z0-9]+", body.lower()))
                shared = len(have & want)
                if want and shared >= math.ceil(round(threshold * len(want), 9)):
                    out.append((i, n, name, shared))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_every_licence_block_is_found(spark, clashing, awkward, threshold):
    mit, gpl = L.TEMPLATES["mit-grant"], L.TEMPLATES["gpl-header"]
    words = mit.split()
    rows = [*awkward, (20, f"x\n{mit}\n\n{gpl.upper()} and more\n"), (21, " ".join(words[::-1])), (22, " ".join(w for i, w in enumerate(words) if i % 6)), (23, " ".join(w for i, w in enumerate(words) if i % 3)), (24, "Licensed under CC BY 4.0, license the the"), (24, "Licensed under CC BY 4.0, license the the"), (25, "a " * 100_000 + mit)]
    got = sorted(((r.doc_id, r.block, r.template, r.overlap) for r in L.scan(clashing(rows), threshold=threshold).collect()), key=str)
    assert got == brute(rows, L.TEMPLATES, threshold) and got


def test_licences_of_nothing(spark, frame):
    assert L.scan(frame([])).count() == 0
    assert L.scan(frame([(1, "MIT License")]), templates={}).count() == 0
    assert L.scan(frame([(1, "MIT License")]), templates={"empty": "..."}).count() == 0
