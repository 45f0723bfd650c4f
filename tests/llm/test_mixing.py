from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest

from textloom.llm import mixing as M


def cheapest(supply, quotas, copies):
    """(tokens routed, cost) of the best flow, by trying all whole flows."""
    links = [(p, c) for p in supply for c in range(len(quotas)) if p >> c & 1]
    best = (0, 0)
    for flow in itertools.product(*[range(min(quotas[c], supply[p] * copies) + 1) for p, c in links]):
        by_p, by_c = Counter(), Counter()
        for (p, c), f in zip(links, flow, strict=True):
            by_p[p] += f
            by_c[c] += f
        if any(by_p[p] > supply[p] * copies for p in supply) or any(by_c[c] > quotas[c] for c in by_c):
            continue
        cost = sum(k for p in supply for i in range(by_p[p]) for k in [i // supply[p]])
        best = max(best, (sum(flow), -cost))
    return best


@pytest.mark.parametrize("supply,quotas,copies", [({1: 2, 2: 3, 3: 2}, [4, 5], 2), ({1: 1, 3: 2}, [5, 1], 3), ({4: 2, 5: 1, 3: 1}, [2, 1, 3], 2), ({2: 3}, [2, 2], 2), ({}, [1], 1)])
def test_route_is_the_cheapest_largest_flow(supply, quotas, copies):
    flows = M.route(supply, quotas, copies)
    total = sum(map(sum, flows.values()))
    cost = sum(i // supply[p] for p, f in flows.items() for i in range(sum(f)))
    assert (total, -cost) == cheapest(supply, quotas, copies)
    for c, q in enumerate(quotas):
        assert sum(f[c] for f in flows.values()) <= q
    for p, f in flows.items():
        assert sum(f) <= supply[p] * copies and all(not f[c] or p >> c & 1 for c in range(len(quotas)))


SOURCES = [("long", "length(text) >= 200", 0.3), ("odd", "doc_id % 2 = 1", 0.5), ("few", "doc_id % 10 = 0", 0.2)]


def docs(n=3000):
    rng = np.random.default_rng(2)
    return [(i, " ".join(f"w{k}" for k in rng.integers(0, 999, rng.integers(1, 90)))) for i in range(n)]


def test_sources_reach_their_quotas(spark, frame):
    rows = docs()
    size = {i: len(t.split()) for i, t in rows}
    got = M.mix(frame(rows), SOURCES, budget=0.9).collect()
    total = sum(size.values())
    tokens = Counter()
    for r in got:
        tokens[r.mix_source] += size[r.doc_id]
        assert r.n_tokens == size[r.doc_id]
        text = dict(rows)[r.doc_id]
        assert {"long": len(text) >= 200, "odd": r.doc_id % 2 == 1, "few": r.doc_id % 10 == 0}[r.mix_source]
    for name, _, w in SOURCES:
        assert tokens[name] == pytest.approx(0.9 * total * w, abs=4 * max(size.values()))
    # The second copy of a document comes only with its first.
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    assert max(map(len, copies.values())) > 1, "the small source is repeated"


def test_selection_is_that_of_the_sorted_documents(spark, frame):
    """Within a pattern, the documents of lowest hash are taken, up to the nearest token total."""
    rows = docs(800)
    sources = [("all", "true", 1.0)]
    got = {r.doc_id for r in M.mix(frame(rows), sources, budget=0.4).collect()}
    marked = M.marks(frame(rows), sources, M.SEED, "doc_id", "text").collect()
    order = sorted((r.place, r.in_0, len(r.in_1.split())) for r in marked)
    target, total = round(0.4 * sum(n for *_, n in order)), 0
    options = [(abs(target), 0)]
    for k, (_, _, n) in enumerate(order):
        total += n
        options.append((abs(target - total), k + 1))
    assert got == {i for _, i, _ in order[: min(options)[1]]}


def test_documents_come_once_for_each_copy(spark, clashing, awkward):
    df = clashing(awkward)
    out = M.mixed_documents(df, [("all", "lang = 'en'", 1.0)], budget=2.0, max_copies=2)
    assert out.columns == df.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[5] == 2 and ids[6] == 4 and ids[None] == 2 and not {1, 2, 3, 4} & set(ids)


def test_many_sources(spark, frame):
    rows = [(i, "a b c d") for i in range(400)]
    sources = [(f"s{k}", f"doc_id % 40 = {k}", 1 / 40) for k in range(40)]
    got = M.mix(frame(rows), sources, budget=0.5).collect()
    tokens = Counter()
    for r in got:
        assert r.mix_source == f"s{r.doc_id % 40}"
        tokens[r.mix_source] += r.n_tokens
    assert set(tokens.values()) == {20} and len(tokens) == 40


def test_null_predicates_and_empty_tables(spark, frame):
    assert M.mix(frame([])).count() == 0
    assert M.mix(frame([(1, None), (2, "")])).count() == 0
    assert M.mix(frame([(1, "a b")]), [("none", "nullif(lang, 'en') = 'x'", 1.0)]).count() == 0
