from __future__ import annotations

import math

import numpy as np
import pytest

from textloom.llm import classifier as C


def corpus(n=1200, seed=4):
    """Good texts use one half of a vocabulary more, bad ones the other; one in twenty labels is wrong."""
    rng = np.random.default_rng(seed)
    good, bad, both = ([f"{p}{i}" for i in range(150)] for p in "gbn")
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.7)
        own = rng.choice(good if y else bad, rng.integers(8, 40))
        rows.append((i, " ".join([*own, *rng.choice(both, rng.integers(8, 40))])))
        labels.append((i, y if rng.random() > 0.05 else 1 - y, 0))
    return rows, labels


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_calibration(spark, frame):
    rows, labels = corpus()
    truth = {i: " g" in " " + t for i, t in rows}
    got = {r.doc_id: r.p_good for r in C.classify_documents(frame(rows), labelled(spark, labels[:800])).collect()}
    held = range(800, 1200)
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.95
    p, y = np.array([got[i] for i in held]), np.array([labels[i][1] for i in held])
    assert abs(p.mean() - y.mean()) < 0.07
    loss = -np.mean(np.where(y, np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))))
    assert loss < 0.35, "labels are 95 % right, so about 0.2 can be reached"


def test_temperature_mends_confidence():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert C.fit_temperature(3 * z, y) == pytest.approx(3, rel=0.15)
    assert C.fit_temperature(z / 2, y) == pytest.approx(0.5, rel=0.15)


def test_word_vectors_are_sums_of_index_vectors(spark, frame):
    texts = ["a b c", "c B, a", "a", None, ""]
    buckets, d, window = 64, 8, 1
    got = C.count_contexts(frame(list(enumerate(texts))).select("text"), buckets, d, window, 3)
    plus, minus = C.index_vectors(buckets, d, 3)
    want = np.zeros((buckets, d), int)
    for t in texts:
        b = C.token_buckets([t], buckets)[0]
        for i in range(len(b)):
            for j in range(max(0, i - window), min(len(b), i + window + 1)):
                want[b[i], plus[b[j]]] += 1
                want[b[i], minus[b[j]]] -= 1
    assert (got == want).all()


def test_labels_of_one_class_or_none(spark, frame):
    rows, labels = corpus(30)
    one = C.classify_documents(frame(rows), labelled(spark, [(i, 1, 0) for i in range(9)])).collect()
    assert {r.p_good for r in one} == {1.0}
    none = C.classify_documents(frame(rows), labelled(spark, [(None, 1, 0), (3, None, 0)])).collect()
    assert {r.p_good for r in none} == {0.5}


def test_awkward_rows(spark, clashing, awkward):
    docs = clashing(awkward)
    labels = labelled(spark, [(5, 1, 0), (6, 0, 0), (6, 1, 0), (7, 1, 0), (8, 0, 0), (99, 1, 0)])
    got = C.classify_documents(docs, labels).collect()
    assert len(got) == len(awkward)
    assert all(r.p_good == 0.0 and not r.keep for r in got if r.doc_id in (1, 2, 3))
    assert all(0 <= r.p_good <= 1 for r in got if r.doc_id in (5, 6, 7, 8, 9))
    kept = C.keep_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    assert C.classify_documents(docs.limit(0), labels).count() == 0


def test_the_fit_is_the_same_each_time(spark, frame):
    rows, labels = corpus(200)
    a, b = ({r.doc_id: r.p_good for r in C.classify_documents(frame(rows).repartition(k), labelled(spark, labels)).collect()} for k in (2, 5))
    assert a == pytest.approx(b, abs=1e-5)


def brute(rows, labels):
    """p_good of every row: contexts, vectors and means token by token, the network by its formula."""
    plus, minus = C.index_vectors(C.BUCKETS, C.DIMENSIONS, C.SEED)
    sums = {}
    for _, t in rows:
        b = C.token_buckets([t], C.BUCKETS)[0].tolist()
        for i, x in enumerate(b):
            own = sums.setdefault(x, np.zeros(C.DIMENSIONS))
            for j in range(max(0, i - C.WINDOW), min(len(b), i + C.WINDOW + 1)):
                own[plus[b[j]]] += 1
                own[minus[b[j]]] -= 1
    vector = {x: v / max(np.sqrt((v * v).sum()), 1e-12) for x, v in sums.items()}

    def mean(t):
        b = C.token_buckets([t], C.BUCKETS)[0].tolist()
        return sum(vector[x] for x in b) / len(b) if b else np.zeros(C.DIMENSIONS)

    good = {}
    for i, y in labels:
        if i is not None and y is not None:
            good[i] = min(y, good.get(i, 1))
    text = {}
    for i, t in rows:
        if i in good:
            assert i not in text, "only ids of one row here"
            text[i] = t
    ids = sorted(text)
    net = C.fit_network(np.array([mean(text[i]) for i in ids], np.float32).reshape(len(ids), C.DIMENSIONS), np.array([float(good[i] > 0) for i in ids]))

    def probability(t):
        if not len(C.token_buckets([t], C.BUCKETS)[0]):
            return 0.0
        if net.constant is not None:
            return net.constant
        hidden = [math.tanh(sum((m - a) / s * w for m, a, s, w in zip(mean(t), net.mean, net.scale, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(len(net.b1))]
        return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature))

    return [(i, probability(t)) for i, t in rows]


def test_the_query_is_as_brute_force(spark, frame, tmp_path):
    rows, labels = corpus(260, 9)
    rows += [(None, "g1 b1 n1"), (900, None), (901, ""), (902, "BIG Words, and; signs!")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, labels[:200]).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r.doc_id, r.p_good, r.keep) for r in C.query(spark, str(tmp_path)).collect()), key=str)
    want = sorted(brute(rows, [(i, y) for i, y, _ in labels[:200]]), key=str)
    assert [i for i, *_ in got] == [i for i, _ in want]
    assert [p for _, p, _ in got] == pytest.approx([p for _, p in want], abs=2e-3)
    assert all(keep == (p >= C.THRESHOLD and p > 0) for _, p, keep in got)
    assert {keep for *_, keep in got} == {True, False}


def test_a_labelled_id_of_many_rows_is_fitted_once(spark, frame):
    """Thousands of rows under one labelled id: one of them counts, whatever their order."""
    rows, labels = corpus(120)
    more = rows + [(0, f"b{k % 150} again g{k}") for k in range(400)]
    a, b = (sorted((r.doc_id, r.p_good) for r in C.classify_documents(frame(x), labelled(spark, labels)).collect()) for x in (more, more[::-1]))
    assert [i for i, _ in a] == [i for i, _ in b] and len(a) == len(more)
    assert [p for _, p in a] == pytest.approx([p for _, p in b], abs=1e-5)
