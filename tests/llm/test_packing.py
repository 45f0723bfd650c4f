from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

from textloom.llm import lexical
from textloom.llm import packing as P


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(topics[rng.integers(8)], rng.integers(1, 60))) + ["the"] * rng.integers(0, 5)
        rows.append((i, " ".join(words)))
    return rows


def brute(rows, window, postings, waves=P.WAVES):
    """The same waves from dictionaries: every score of every pair is computed."""
    texts = [t for _, t in rows]
    w = lexical.words(texts)
    keys, h = P.keys_of(np.array([i for i, _ in rows], np.int64), w.first, w.hashes()), w.hashes().view(np.int64)
    docs = {}
    for k, (i, t) in enumerate(rows):
        if t.split():
            docs[int(keys[k]), k] = (i, Counter(t.split()), len(t.split()), int(h[w.first[k] : w.first[k + 1]].view(np.uint64).min().view(np.int64)))
    n = len(docs)
    mean = sum(d[2] for d in docs.values()) / n
    df = Counter(x for d in docs.values() for x in d[1])
    code = {x: int(lexical.words([x]).hashes()[0] >> np.uint64(16)) for x in df}

    def gain(x, d):
        tf, length = d[1][x], d[2]
        impact = max(1, round(255 * tf / (tf + P.K1 * (1 - P.B + P.B * length / mean))))
        return round(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * impact)

    def question(d):
        out, total = [], 0
        for f, _, x in sorted((df[x], code[x], x) for x in d[1] if 2 <= df[x] <= postings):
            total += f
            if total > postings:
                break
            out.append(x)
        return out

    size = {i: d[2] % window for i, d in docs.items() if d[2] % window}
    own: dict = {}
    unused, high, wave = set(size), 0, 0
    while unused and wave < waves:
        mass, space = sum(size[i] for i in unused), sum(window - sum(size[j] for j in x) for x in own.values())
        top = min(1 << 15, high + math.ceil(((1 << 15) - high) * (max(0.0, mass - space) / window / len(unused))))
        if top > high:
            for i in sorted(unused):
                if i[0] < top:
                    own[i] = [i]
                    unused.discard(i)
            high = top
        room = {s: window - sum(size[j] for j in x) for s, x in own.items()}
        asks = {s: question(docs[s]) for s in own if room[s] >= max(1, window // P.NEARLY_FULL)}
        wants: dict = {}
        for i in unused:
            found = [(-sum(gain(x, docs[i]) for x in q if x in docs[i][1]), s) for s, q in asks.items() if size[i] <= room[s] and any(x in docs[i][1] for x in q)]
            if found:
                score, s = min(found)
                wants.setdefault(s, []).append((score, i))
        placed = 0
        for s, those in wants.items():
            total = 0
            for _, i in sorted(those):
                total += size[i]
                if total > room[s]:
                    break
                own[s].append(i)
                unused.discard(i)
                placed += 1
        wave += 1
        if placed < P.LITTLE * len(size):
            break
    stream = [(docs[i][3], size[i], i, 0) for i in unused] + [(docs[s][3], 0, s, window - sum(size[j] for j in x)) for s, x in own.items()]
    pool: list = []
    for _, s, i, room in sorted(stream):
        into = i
        if s:
            k = next((k for k, (f, _) in enumerate(pool) if f >= s), None)
            room, into = pool.pop(k) if k is not None else (window, i)
            own.setdefault(into, []).append(i)
            room -= s
        if room:
            pool.insert(next((k for k, (f, _) in enumerate(pool) if f > room), len(pool)), (room, into))
            del pool[: max(0, len(pool) - P.OPEN)]
    out = [[(docs[i][0], docs[i][2] - size[i], size[i]) for i in x] for x in own.values()]
    return sorted(out + [[(d[0], k * window, window)] for d in docs.values() for k in range(d[2] // window)])


def windows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.window, []).append((r.slot, r.doc_id, r.first_token, r.n_tokens))
    for w in out.values():
        w.sort()
        assert [s for s, *_ in w] == list(range(len(w)))
    return [[x[1:] for x in w] for w in out.values()]


def test_windows_are_those_of_brute_force(spark, frame):
    rows = corpus(300) + [(1000, " ".join(f"t1w{i % 60}" for i in range(777)))]
    want = brute(rows, 100, 60)
    assert sorted(windows(P.pack(frame(rows).coalesce(1), window=100, postings=60))) == want
    # However many lists and shards there are, and however the rows are partitioned.
    again = windows(P.pack(frame(rows).coalesce(1), window=100, postings=60, list_tokens=150, shard_tokens=900, shard_docs=20))
    assert sorted(again) == want


def test_a_hot_word_and_a_hot_text(spark, frame):
    """A third of the rows are one text; their words are in more documents than a query may ask for."""
    rows = corpus(100, 3) + [(2000 + i, "copy of one text that everybody has") for i in range(60)]
    want = brute(rows, 64, 30)
    for lists in (100, 1000):
        got = windows(P.pack(frame(rows).coalesce(1), window=64, postings=30, list_tokens=lists, shard_tokens=500, shard_docs=10))
        assert sorted(got) == want and sum(len(w) for w in got) == len(rows)


def test_every_word_is_asked_for(spark, frame):
    """No cap: words of nearly all documents count, and windows are those of all scores of all pairs."""
    rng = np.random.default_rng(9)
    frequent = [f"f{i}" for i in range(40)]
    rows = [(i, t + " " + " ".join(rng.choice(frequent, 12))) for i, t in corpus(250, 5)] + [(1000, " ".join(f"t1w{i % 60}" for i in range(777))), (1001, "zebra")]
    want = brute(rows, 100, 10**9)
    assert want != brute(rows, 100, 1024)
    assert sorted(windows(P.pack(frame(rows).coalesce(1), window=100))) == want
    # However many lists there are.
    assert sorted(windows(P.pack(frame(rows).coalesce(1), window=100, list_tokens=1500, shard_tokens=5000))) == want


def test_scores_are_the_same_however_they_are_added_up(monkeypatch):
    """By products alone, by pairs alone and by both, in small pieces and in one."""
    rng = np.random.default_rng(1)
    terms = np.sort(rng.choice(1 << 40, 60, replace=False).astype(np.uint64))
    gain, has = rng.integers(1, 3000, (60, 33)) * (rng.random((60, 33)) < 0.2), rng.random((60, 21)) < 0.3

    def inverted(table, weighed):
        some = (table != 0).any(1)
        return P.Inverted(terms[some], (table[some] != 0).sum(1), np.nonzero(table[some])[1], table[some][table[some] != 0] if weighed else None)

    want = gain.T @ has
    for dense, words, pairs in ((0, 1024, 50), (1 << 40, 7, 50), (10, 9, 20), (400, 1024, 10**6)):
        for name, value in (("DENSE", dense), ("CELL_WORDS", words), ("CELL_PAIRS", pairs)):
            monkeypatch.setattr(P, name, value)
        assert (P.scores(inverted(gain, True), inverted(has, False), 33, 21, np.float32) == want).all()


def zipf_words(rng, n, terms, most):
    """For each of n texts which of the terms (the first ones in many texts) it has."""
    return rng.random((n, terms)) < (most / np.arange(1, terms + 1) ** 0.7)[None, :]


def as_inverted(table, weighed):
    some = (table != 0).any(0)
    own = table[:, some].T
    return P.Inverted((np.flatnonzero(some) * 7 + 5).astype(np.uint64), (own != 0).sum(1), np.nonzero(own)[1].astype(np.int32), own[own != 0].astype(np.int32) if weighed else None)


def test_the_best_windows_are_those_of_all_scores(monkeypatch):
    """Bounds leave out only seeds that can't be the best: many blocks, closed and narrow windows, ties and words of no weight."""
    rng = np.random.default_rng(4)
    docs, seeds = zipf_words(rng, 70, 500, 0.9), zipf_words(rng, 240, 500, 0.9)
    docs[:20], seeds[100:110] = seeds[:20], seeds[:10]  # copies, twice of some
    docs[20:30] = False
    docs[20:30, :2] = True  # many seeds score the same
    docs[30] = False
    gain = docs * rng.integers(1, 9, docs.shape) * np.arange(0, 1000, 2)[None, :] // 50
    size, room = rng.integers(1, 40, 70), rng.integers(0, 45, 240) * (rng.random(240) < 0.9)
    names = np.sort(rng.choice(10**6, 240, replace=False))
    all_scores = (gain.astype(np.int64) @ seeds.T) * (size[:, None] <= room)
    want = all_scores.max(1), np.where(all_scores.max(1) > 0, names[all_scores.argmax(1)], 0)
    own, parts = as_inverted(gain, True), np.array_split(rng.permutation(240), 4)
    counts = seeds.sum(0)[(own.terms.astype(np.int64) - 5) // 7]
    for surplus, often, cells, pairs, hubs in ((0.2, 256, 1 << 21, 1 << 16, 64), (0, 4, 500, 50, 2), (0.5, 1, 7, 10**6, 1), (0.1, 40, 3000, 300, 9)):
        for name, value in (("SURPLUS", surplus), ("OFTEN", often), ("CELLS", cells), ("CELL_PAIRS", pairs), ("LARGE", hubs)):
            monkeypatch.setattr(P, name, value)
        best = P.Best(size, own, counts)
        for k, part in enumerate(np.sort(x) for x in parts):
            block = names[part], as_inverted(seeds[part], False), room[part]
            if not k:
                best.large(*block)
            best.meet(*block)
        assert (best.score == want[0]).all() and (best.window == want[1]).all()
        assert (best.space[best.score > 0] == room[np.searchsorted(names, best.window[best.score > 0])]).all()


def test_few_pairs_are_looked_at(monkeypatch):
    """Work doesn't grow with all pairs that share a word, whether they are expanded or multiplied."""
    rng = np.random.default_rng(8)
    docs, seeds = zipf_words(rng, 100, 4000, 0.9), zipf_words(rng, 1500, 4000, 0.9)
    docs[:50] = seeds[:50]
    gain = docs * np.round(20 * np.log1p(1500 / (1 + seeds.sum(0)))).astype(np.int64)[None, :]
    seen, ragged = [], P.lexical.ragged
    monkeypatch.setattr(P.lexical, "ragged", lambda starts, sizes: seen.append(int(sizes.sum())) or ragged(starts, sizes))
    own = as_inverted(gain, True)
    best = P.Best(np.ones(100, np.int64), own, seeds.sum(0)[(own.terms.astype(np.int64) - 5) // 7])
    block = np.arange(1500), as_inverted(seeds, False), np.ones(1500, np.int64)
    best.large(*block)
    best.meet(*block)
    scores = gain @ seeds.T.astype(np.int64)
    assert (best.score == scores.max(1)).all() and (best.window == scores.argmax(1)).all()
    assert sum(seen) < 0.5 * ((gain > 0).sum(0) * seeds.sum(0)).sum()


def test_every_token_is_in_one_window(spark, frame):
    rows = corpus(400, 1) + [(1000, " ".join(f"x{i}" for i in range(1234)))]
    sizes = {i: len(t.split()) for i, t in rows}
    got = windows(P.pack(frame(rows), window=64, list_tokens=1000, shard_docs=50))
    covered = Counter()
    for w in got:
        assert sum(n for *_, n in w) <= 64
        for i, first, n in w:
            covered[i] += n
            assert 0 <= first and first + n <= sizes[i] and n > 0
    assert covered == sizes


def test_neighbours_share_windows(spark, frame):
    """Documents of a topic are together far more often than by chance."""
    rows = corpus(300, 2)
    got = windows(P.pack(frame(rows), window=128))
    topic = {i: Counter(w[:2] for w in t.split() if w != "the").most_common(1)[0][0] if t.replace("the", "").strip() else "" for i, t in rows}
    same = [topic[w[0][0]] == topic[d] for w in got for d, *_ in w[1:]]
    assert np.mean(same) > 0.5


def test_awkward_rows(spark, clashing, awkward):
    got = [p for w in windows(P.pack(clashing(awkward), window=50)) for p in w]
    count = Counter(i for i, first, _ in got if first == 0)
    assert count[6] == 2 and count[8] == 2 and count[None] == 1 and not {1, 2, 3, 4} & set(count)
    assert sum(n for i, _, n in got if i == 5) == 120_000


def test_many_equal_rows(spark, frame):
    got = windows(P.pack(frame([(1, "same words here")] * 300), window=10, shard_docs=8, list_tokens=20))
    assert sum(len(w) for w in got) == 300 and max(map(len, got)) == 3


def test_near_duplicates_share_windows(spark, frame):
    """Pairs among thousands of other documents: no shard keeps them apart."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(4000)]
    common = ["the", "of", "and", "to", "in"]
    rows = [(i, " ".join([*rng.choice(vocabulary, 30), *rng.choice(common, 15)])) for i in range(1200)]
    rows += [(5000 + i, rows[i][1] + " " + vocabulary[i]) for i in range(0, 300)]
    at = {d: k for k, w in enumerate(windows(P.pack(frame(rows), window=450, list_tokens=4000, shard_tokens=9000, shard_docs=100))) for d, *_ in w}
    assert np.mean([at[i] == at[5000 + i] for i in range(300)]) > 0.5


def test_empty_table(spark, frame):
    assert P.pack(frame([])).count() == 0
    assert P.pack(frame([(1, None), (2, "")])).count() == 0


def brute_by_queries(rows, asks, window):
    """Windows from dictionaries: every score of every document and query is computed."""
    w = lexical.words([t for _, t in rows])
    h = w.hashes()
    keys = P.keys_of(np.array([i or 0 for i, _ in rows], np.int64), w.first, h)
    docs = {(int(keys[k]), k): (i, Counter(t.split()), len(t.split()), int(h[w.first[k] : w.first[k + 1]].min().view(np.int64))) for k, (i, t) in enumerate(rows) if t and t.split()}
    n, mean = len(docs), sum(d[2] for d in docs.values()) / len(docs)
    df = Counter(x for d in docs.values() for x in d[1])

    def score(words, d):
        impact = {x: max(1, round(255 * d[1][x] / (d[1][x] + P.K1 * (1 - P.B + P.B * d[2] / mean)))) for x in d[1] if x in words}
        return sum(round(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * v) for x, v in impact.items())

    queries = [i for i in sorted(docs) if docs[i][0] is not None and asks(docs[i][0])]
    best = {i: (-(1 << 62), i) if i in queries else min(((-score(docs[q][1], docs[i]), q) for q in queries), default=(0, None)) for i in docs}
    best = {i: b if b[0] else (0, None) for i, b in best.items()}
    size = {i: d[2] % window for i, d in docs.items() if d[2] % window}
    room = lambda x: window - sum(size[i] for i in x)
    closed, others = [], []

    def shelve(pool, x):
        if not room(x):
            closed.append(x)
            return
        pool.append(x)
        pool.sort(key=room)  # of equal space the one that came first
        if len(pool) > P.OPEN:
            closed.append(pool.pop(0))

    for q in sorted({b[1] for b in best.values()}, key=lambda q: (q is None, q)):
        own, now = [], []
        those = sorted((i for i in size if best[i][1] == q), key=lambda i: (best[i][0], i))
        ahead = sum(total <= window for total in accumulate(size[i] for i in those)) if q else 0
        for i in those[:ahead] + sorted(those[ahead:], key=lambda i: (docs[i][3], size[i], i)):
            if now and size[i] <= room(now):
                now.append(i)
            elif fit := [x for x in own if size[i] <= room(x)]:
                own.remove(fit[0])
                shelve(own, [*fit[0], i])
            else:
                if now:
                    shelve(own, now)
                now = [i]
        if now:
            shelve(own, now)
        for x in own:
            fit = [y for y in others if window - room(x) <= room(y)]
            if fit:
                others.remove(fit[0])
            shelve(others, [*(fit[0] if fit else []), *x])
    out = [[(docs[i][0], docs[i][2] - size[i], size[i]) for i in x] for x in closed + others]
    return by_ids(out + [[(d[0], k * window, window)] for d in docs.values() for k in range(d[2] // window)])


def by_ids(found):
    return sorted(found, key=lambda w: [(d is None, d or 0, a, b) for d, a, b in w])


@pytest.fixture
def small_batches(spark):
    """A list ends after a batch only, so small tables have several lists with these."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "15")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_each_document_is_with_the_query_that_scores_it_best(spark, frame, monkeypatch, small_batches):
    """Every word of every document and query counts, whatever the lists and blocks; groups have as many windows as they fill."""
    rng = np.random.default_rng(9)
    frequent = [f"f{i}" for i in range(40)]
    rows = [(i, t + " " + " ".join(rng.choice(frequent, 12))) for i, t in corpus(250, 5)]
    rows += [(1000, " ".join(f"t1w{i % 60}" for i in range(777))), (1001, "zebra"), (1002, None), (1003, ""), (None, rows[7][1]), (20, rows[20][1]), (21, rows[21][1])]
    for asks, column in ((lambda i: i % 20 == 0, lambda c: c % 20 == 0), (lambda i: i == 40, lambda c: c == 40), (lambda i: i < 0, lambda c: c < 0)):
        want = brute_by_queries(rows, asks, 100)
        assert by_ids(windows(P.pack_by_queries(frame(rows).coalesce(1), column, window=100))) == want
    monkeypatch.setattr(P, "OPEN", 3)
    want, lists, indexed = brute_by_queries(rows, lambda i: i % 20 == 0, 100), [], P.indexed
    monkeypatch.setattr(P, "indexed", lambda *a: lists.append(indexed(*a)) or lists[-1])
    assert by_ids(windows(P.pack_by_queries(frame(rows).coalesce(1), lambda c: c % 20 == 0, window=100, list_tokens=300, shard_tokens=2000))) == want
    assert lists[0][2].select("list").distinct().count() > 10


def test_the_query_asks_for_ids_that_50_divides(spark, frame, tmp_path):
    """Against all rows, each of which is packed."""
    rows = corpus(400, 3)
    frame(rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = windows(P.query(spark, str(tmp_path)))
    assert by_ids(got) == brute_by_queries(rows, lambda i: i % 50 == 0, P.WINDOW)
    assert sorted(d for w in got for d, *_ in w) == list(range(400))


def test_queries_in_blocks_and_rows_in_partitions(spark, frame, monkeypatch, small_batches):
    """Every token is in one window, and results of the search don't depend on blocks."""
    rows = corpus(400, 1) + [(1000, " ".join(f"x{i}" for i in range(1234)))]
    want = by_ids(windows(P.pack_by_queries(frame(rows).coalesce(1), lambda c: c % 7 == 0, window=64)))
    monkeypatch.setattr(P, "CELL_SEEDS", 10)
    assert by_ids(windows(P.pack_by_queries(frame(rows).coalesce(1), lambda c: c % 7 == 0, window=64, list_tokens=1000))) == want
    got = windows(P.pack_by_queries(frame(rows), lambda c: c % 7 == 0, window=64, fill_docs=90))
    covered, sizes = Counter(), {i: len(t.split()) for i, t in rows}
    for x in got:
        assert sum(n for *_, n in x) <= 64
        for i, first, n in x:
            covered[i] += n
            assert 0 <= first and first + n <= sizes[i] and n > 0
    assert covered == sizes


def test_no_words_and_queries(spark, frame):
    assert P.pack_by_queries(frame([]), lambda c: c % 50 == 0).count() == 0
    assert P.pack_by_queries(frame([(0, None), (50, "")]), lambda c: c % 50 == 0).count() == 0
