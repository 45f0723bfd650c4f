from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import simhash as S


def popcounts(a, b):
    return np.bitwise_count(a[:, None] ^ b[None, :])


@pytest.mark.parametrize("radius", [0, 2, 5, 12, 30])
def test_vantage_tree_finds_all_pairs_once(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    lead = np.concatenate([base, near, base[:50]])
    everything = np.arange(len(lead))
    d = popcounts(lead, lead)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j}
    got = [tuple(sorted(p)) for i, j in S.vantage_pairs(lead, everything, None, radius, least=500) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want)
    left, right = everything[:250], everything[250:]
    got = [p for i, j in S.vantage_pairs(lead, left, right, radius, least=500) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(got) == {(i, j) for i, j in want if i < 250 <= j} and len(got) == len(set(got))


def test_triangle_bounds_prune(monkeypatch):
    """With a small radius the tree compares far fewer pairs than all."""
    lead = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    compared = 0
    count = np.bitwise_count

    def counted(x):
        nonlocal compared
        compared += x.size if x.ndim == 2 else 0
        return count(x)

    monkeypatch.setattr(S.np, "bitwise_count", counted)
    list(S.vantage_pairs(lead, np.arange(4000), None, 1, least=10_000))
    assert compared < 0.5 * 4000 * 4000 / 2


@pytest.mark.parametrize("radius", [3, 64, 100])
@pytest.mark.parametrize("edge", [None, 400])
def test_buckets_find_all_pairs_once(monkeypatch, radius, edge):
    """Pairs at every distance around the radius: each is found by one block, within groups and between them."""
    monkeypatch.setattr(S, "LEAST_BITS", 5)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (500, 4), dtype=np.uint64)
    copies = base.copy()
    for k in range(500):  # k % 80 + radius - 40 bits differ
        copies[k] ^= np.packbits(np.isin(np.arange(256), rng.choice(256, max(0, k % 80 + radius - 40), replace=False))).view(np.uint64)
    fp = np.concatenate([base, copies])
    d = np.bitwise_count(fp[:, None] ^ fp).sum(2)
    left, right = (np.arange(1000), None) if edge is None else (np.arange(edge), np.arange(edge, 1000))
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(d <= radius)), strict=True) if i < j and (edge is None or i < edge <= j)}
    blocks = S.bit_blocks(1000, radius)
    assert sum(t + 1 for *_, t in blocks) == radius + 1 and sum(w for _, w, _ in blocks) == 256
    got = [tuple(sorted(p)) for b in range(len(blocks)) for part in range(3) for i, j in S.bucket_pairs(fp, left, right, radius, b, blocks, part, 3) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want) > 100
    strips = [tuple(sorted(p)) for part in range(3) for i, j in S.strip_pairs(fp, left, right, radius, part, 3) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(strips) == want and len(strips) == len(want)


def test_large_cells_compare_a_fifth_of_all_pairs():
    """At the query's radius, by codes that are spread evenly."""
    ball = lambda width, t: np.count_nonzero(np.bitwise_count(np.arange(1 << width)) <= t) / (1 << width)
    shares = [sum(ball(w, t) for _, w, t in S.bit_blocks(n, S.RADIUS)) for n in (1 << 18, S.GROUP * 2)]
    assert shares[0] < 0.4 and shares[1] < 0.22


def brute(rows):
    """Groups by the definition: near pairs of fingerprints, then connected components."""
    texts = [t for i, t in rows if i is not None]
    ids = [i for i, _ in rows if i is not None]
    df = np.zeros(S.BUCKETS + 1, np.int64)
    for _, t in rows:
        df[:-1] += np.bincount(S.feature_buckets([t], S.BUCKETS)[0], minlength=S.BUCKETS)
    df[-1] = len(rows)
    table = S.sign_table(S.bucket_weights(df))
    fp, sizes = S.fingerprints_of(texts, table)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sizes[a] and sizes[b] and (ids[a] == ids[b] or np.bitwise_count(fp[a] ^ fp[b]).sum() <= S.RADIUS):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: find(i) for i in ids if find(i) != i}


def corpus(n=120, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    rows, i = [], 0
    for _ in range(n):
        words = list(rng.choice(vocabulary, rng.integers(5, 200)))
        rows.append((i, " ".join(words)))
        i += 1
        for _ in range(rng.integers(0, 3)):
            edited = [w if rng.random() > 0.05 else str(rng.choice(vocabulary)) for w in words]
            rows.append((i, " ".join(edited) + "."))
            i += 1
    return rows


def test_groups_are_those_of_brute_force(spark, frame):
    rows = corpus() + [(5000, "one two three"), (5001, "one two three"), (5001, "something else altogether here")]
    got = {r.doc_id: r.duplicate_of for r in S.groups_of(frame(rows)).collect()}
    assert got == brute(rows)
    # Small cells give the same.
    assert {r.doc_id: r.duplicate_of for r in S.groups_of(frame(rows), group=20).collect()} == got


@pytest.mark.parametrize("group", [10_000, 90])
def test_groups_by_buckets_are_those_of_brute_force(spark, frame, monkeypatch, group):
    """Cells with buckets, within groups and between them."""
    rows = corpus(80, 7)
    plain = {r.doc_id: (r.duplicate_of, r.n_links) for r in S.groups_of(frame(rows)).collect()}
    monkeypatch.setattr(S, "LEAST_BITS", 1)
    assert {r.doc_id: (r.duplicate_of, r.n_links) for r in S.groups_of(frame(rows), group=group).collect()} == plain
    assert {i: root for i, (root, _) in plain.items()} == brute(rows)


@pytest.mark.parametrize("group", [10_000, 25])
def test_links_are_counted_over_all_cells(spark, frame, group):
    rows = corpus(60, 4)
    df = np.zeros(S.BUCKETS + 1, np.int64)
    for _, t in rows:
        df[:-1] += np.bincount(S.feature_buckets([t], S.BUCKETS)[0], minlength=S.BUCKETS)
    df[-1] = len(rows)
    fp, _ = S.fingerprints_of([t for _, t in rows], S.sign_table(S.bucket_weights(df)))
    distinct = np.unique(fp, axis=0)
    for r in S.groups_of(frame(rows), group=group).collect():
        own = fp[[i for i, _ in rows].index(r.doc_id)]
        assert r.n_links == (np.bitwise_count(distinct ^ own).sum(1) <= S.RADIUS).sum() - 1


@pytest.mark.parametrize("rows,columns", [(1, 1), (70, 2100), (33, 1024)])
def test_blocks_find_all_pairs_of_wide_fingerprints(rows, columns):
    rng = np.random.default_rng(rows)
    a, b = rng.integers(0, 1 << 63, (rows, 4), dtype=np.uint64), rng.integers(0, 1 << 63, (columns, 4), dtype=np.uint64)
    b[: columns // 2] = a[rng.integers(0, rows, columns // 2)]
    for k in range(columns // 2):  # k bits differ
        b[k] ^= np.packbits(np.isin(np.arange(256), rng.choice(256, k % 130, replace=False))).view(np.uint64)
    fp = np.concatenate([a, b])
    got = {(x, y) for i, j in S.vantage_pairs(fp, np.arange(rows), np.arange(rows, rows + columns), 64) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    d = np.bitwise_count(a[:, None] ^ b).sum(2)
    assert got == {(i, j + rows) for i, j in zip(*(x.tolist() for x in np.nonzero(d <= 64)), strict=True)}


def test_near_copies_are_caught_and_others_left_alone(spark, frame):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(5000)]
    rows = [(i, " ".join(rng.choice(vocabulary, 150))) for i in range(100)]
    copies = []
    for i in range(50):
        words = rows[i][1].split()
        for k in rng.choice(150, 9, replace=False):
            words[k] = str(rng.choice(vocabulary))
        copies.append((1000 + i, " ".join(words).capitalize()))
    got = {r.doc_id: r.duplicate_of for r in S.groups_of(frame(rows + copies)).collect()}
    assert got == {1000 + i: i for i in range(50)}


def test_keeping_one_of_each_group(spark, frame, clashing, awkward):
    docs = clashing(awkward)
    kept = S.keep_documents(docs)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    ids = [i for i, _ in rows]
    assert ids.count(None) == 1 and ids.count(6) == 1 and ids.count(8) == 1
    assert 7 not in ids, "a near copy of 6 goes"
    assert {1, 2, 3, 4, 5, 9} <= set(ids)


def test_empty_table(spark, frame):
    assert S.groups_of(frame([])).count() == 0
    assert S.keep_documents(frame([])).count() == 0
    assert S.groups_of(frame([(1, None), (2, "")])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_components_of_edges_that_change_between_evaluations(spark):
    """Edges that come out differently each time, all of one group, still give the one group."""
    star = spark.range(1, 200).select((F.floor(F.rand() * F.col("id"))).cast("bigint").alias("u"), F.col("id").alias("v"))
    got = S.components(star.select("u", "v"))
    assert got.count() == 200 and {r.root for r in got.select("root").distinct().collect()} == {0}


def test_truncated_and_extended_copies_are_caught(spark, frame):
    """Copies whose sizes differ by more than a fifth, and whose fingerprints are near all the same."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(5000)]
    rows = []
    for i in range(40):
        words = list(rng.choice(vocabulary, 100, replace=False))
        more = list(rng.choice(vocabulary, 25, replace=False))
        rows += [(i, " ".join(words)), (100 + i, " ".join(words + more)), (200 + i, " ".join(words[:78]))]
    got = {r.doc_id: r.duplicate_of for r in S.groups_of(frame(rows)).collect()}
    assert got == {k + i: i for i in range(40) for k in (100, 200)}
    assert {r.doc_id: r.duplicate_of for r in S.groups_of(frame(rows), group=30).collect()} == got
