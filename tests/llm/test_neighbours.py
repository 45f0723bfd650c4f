from __future__ import annotations

import numpy as np
import pytest

from textloom.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in zip(ids, x, strict=True)], SCHEMA)


def brute(x, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("kind", ["sphere", "clusters", "line"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    if kind == "clusters":
        x = rng.normal(size=(6, 24))[rng.integers(0, 6, 600)] * 5 + x * 0.3
    if kind == "line":
        x = np.outer(rng.random(600), np.ones(24)) + x * 1e-3
    got = N.nearest(table(spark, x), shard=200, queries=150).collect()
    want, _ = brute(x, N.K)
    found = {i: set() for i in range(600)}
    for r in got:
        found[r.vec_id].add(r.neighbour_id)
    assert all(len(f) == N.K for f in found.values())
    assert np.mean([len(found[i] & set(want[i].tolist())) / N.K for i in range(600)]) >= 0.9


def test_distances_and_ranks(spark):
    x = np.array([[0, 0], [1, 0], [0, 2], [3, 0], [3, 0]], float)
    rows = {(r.vec_id, r.rank): (r.neighbour_id, r.distance) for r in N.nearest(table(spark, x), k=2).collect()}
    assert rows[0, 1] == (1, 1.0) and rows[0, 2] == (2, 2.0)
    assert rows[3, 1] == (4, 0.0) and rows[1, 2] == (3, 2.0), "equal distances go by id"


def test_awkward_rows(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [1.0]), (None, [0.0, 1.0]), (5, [float("nan"), 0.0]), (6, [0.0, None]), (7, [0.0, 1.0]), (8, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], "vec_id bigint, embedding array<float>, id int, packed int")
    got = sorted((r.vec_id, r["rank"], r.neighbour_id) for r in N.nearest(df).collect())
    assert got == [(1, 1, 7), (1, 2, 8), (7, 1, 1), (7, 2, 8), (8, 1, 1), (8, 2, 7)]


def test_the_query_asks_for_every_fiftieth_against_all(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(700, 16))
    table(spark, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = N.query(spark, str(tmp_path)).collect()
    want, far = brute(x, N.K)
    assert {r.vec_id for r in got} == set(range(0, 700, N.ASKED)) and len(got) == 14 * N.K
    assert np.mean([r.neighbour_id in want[r.vec_id] for r in got]) >= 0.9
    assert all(abs(r.distance - far[r.vec_id][want[r.vec_id].tolist().index(r.neighbour_id)]) < 1e-5 for r in got if r.neighbour_id in want[r.vec_id])


def test_rows_of_one_id_with_other_vectors(spark):
    """Many vectors under one id push no other id out."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 8)) * 1e-3, rng.normal(size=(12, 8))])
    got = N.nearest(table(spark, x, [1] * 400 + list(range(2, 14)))).collect()
    count = {i: sum(r.vec_id == i for r in got) for i in range(1, 14)}
    assert set(count.values()) == {N.K}
    assert len({(r.vec_id, r.neighbour_id) for r in got}) == len(got)


def test_values_beyond_single_precision_are_left_out(spark):
    x = [[0.0, 1.0], [1.0, 1.0], [float("inf"), 0.0], [-2e18, 0.0]]
    assert {(r.vec_id, r.neighbour_id) for r in N.nearest(table(spark, x)).collect()} == {(0, 1), (1, 0)}


def test_no_queries(spark):
    assert N.nearest(table(spark, [[0.0], [1.0]]), asked=lambda i: i > 5).count() == 0


def test_empty_table(spark):
    assert N.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.nearest(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).count() == 0
