"""Every query with SQL of its own gives what DuckDB gives."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, small, db, name):
    df = entry.queries()[name](spark, small)
    r = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple(map(repr, row))
    want = sorted((tuple(norm(v) for v in row) for row in r.fetchall()), key=key)
    got = sorted((tuple(norm(row[c]) for c in columns) for row in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"}))
def test_other_queries_run(spark, small, name):
    if name.startswith("op"):
        pytest.skip("tested with the corpus operators")
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_a_sketch_for_each_type_only(spark, small):
    """Not one for each user of each type."""
    plan = entry.queries()["approximate_users"](spark, small)._jdf.queryExecution().sparkPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketches and not any("user_id" in line.split("functions=")[0] for line in sketches)


def test_tfidf_shuffles_no_words_of_documents(spark, small):
    """Only texts by document, and each word's document frequency."""
    plan = entry.queries()["tfidf_top"](spark, small)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("token#" in line for line in exchanges)
