from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import test_classifier
import test_packing
import test_rules_and_licences
import test_simhash

import corpus_pipeline
from textloom.llm import classifier, mixing, packing, quality_rules, queries


def test_stages(spark, small):
    """Each stage over what the one before kept; filters only drop rows, and the last packs every token."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).toPandas(), docs.schema)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= before, name
        before = now
    words = docs.select(mixing.word_count("text").alias("n")).groupBy().sum("n").first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sum(r.n_tokens for r in packed) == words


def test_good_labelled_documents_are_kept(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    good = labels.where("quality = 1 and toxic = 0")
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, small)
        assert kept.join(good, "doc_id").count() >= 0.95 * docs.join(good, "doc_id").count()
        docs = spark.createDataFrame(kept.toPandas(), docs.schema)


def test_run_and_registry(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def raw_documents(seed):
    """Good and bad texts, junk, near copies, long texts, nulls and blanks, in two languages and some sources."""
    rng = np.random.default_rng(seed)
    good, bad, both = ([f"{p}{i}" for i in range(120)] for p in "gbn")
    rows, labels = [], []
    for i in range(170):
        y = int(rng.random() < 0.75)
        words = [*rng.choice(good if y else bad, rng.integers(20, 70)), *rng.choice(both, rng.integers(5, 30))]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, y, 0))
        if i % 9 == 0:
            words[3] = "changed"
            rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, "$$$ !!! ### " * 9) for i in range(12)]
    rows += [(3000, None), (3001, " "), (3002, " ".join(rng.choice(good, 5000)))]
    full = [(i, t, "en" if i % 3 else "de", f"src{i % 12}", len(t or "")) for i, t in rows]
    return full, labels


def brute(spark, full, labels):
    """The windows of the whole pipeline: each stage's definition worked out row by row."""
    rows = [(r[0], r[1]) for r in full]
    trusted = {i for i, q, x in labels if q == 1 and x == 0}
    rows = [(i, t) for (i, t), (_, s, n) in zip(rows, test_rules_and_licences.scores(rows, trusted, quality_rules.BUCKETS), strict=True) if n and s >= quality_rules.THRESHOLD]
    counts = [len(rows)]
    rows = [r for r, (_, p) in zip(rows, test_classifier.brute(rows, [(i, q) for i, q, _ in labels]), strict=True) if p >= classifier.THRESHOLD]
    counts.append(len(rows))
    gone = test_simhash.brute(rows)
    rows = [r for r in rows if r[0] not in gone]
    counts.append(len(rows))
    by = {r[0]: r for r in full}
    tests = {"english": lambda r: r[2] == "en", "german": lambda r: r[2] == "de", "spanish": lambda r: False, "french": lambda r: False, "main_site": lambda r: r[3] == "src0", "small_sites": lambda r: r[3] in {f"src{k}" for k in range(1, 10)}, "long_form": lambda r: r[4] >= 4000}
    pattern = {i: sum(1 << k for k, (name, *_) in enumerate(mixing.SOURCES) if tests[name](by[i])) for i, _ in rows}
    size = {i: len(t.split()) for i, t in rows}
    place = {r.in_0: r.place for r in mixing.marks(spark.createDataFrame([by[i] for i, _ in rows], COLUMNS), mixing.SOURCES, mixing.SEED, "doc_id", "text").collect()}
    supply = Counter()
    for i in size:
        supply[pattern[i]] += size[i] if pattern[i] else 0
    quotas = [int(round(mixing.BUDGET * sum(size.values()) * w)) for *_, w in mixing.SOURCES]
    copies = Counter()
    for p, flow in mixing.route({p: n for p, n in supply.items() if p}, quotas, mixing.MAX_COPIES).items():
        order = sorted((i for i in size if pattern[i] == p), key=place.get)
        sums = np.concatenate([[0], np.cumsum([size[i] for i in order])])
        cut = lambda t, sums=sums: int(np.argmin(np.abs(sums - t)))
        at = 0
        for f in flow:
            for k in range(mixing.MAX_COPIES):
                a, b = max(at, k * supply[p]), min(at + f, (k + 1) * supply[p])
                if a < b:
                    copies.update(order[cut(a - k * supply[p]) : cut(b - k * supply[p])])
            at += f
    mixed = [(i, t) for i, t in rows for _ in range(copies[i])]
    return test_packing.brute(mixed, packing.WINDOW, packing.POSTINGS), counts


def test_the_whole_run_is_as_brute_force(spark, tmp_path):
    full, labels = raw_documents(1)
    spark.createDataFrame(full, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, counts = brute(spark, full, labels)
    assert len(full) > counts[0] > counts[1] > counts[2] > 50, "every stage decides something"
    # Windows don't depend on the order of their documents' rows, but for equal hashes; slots of equal rows are the same.
    assert sorted(test_packing.windows(corpus_pipeline.run(spark, str(tmp_path)))) == want


@pytest.fixture
def labels_at(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_stages_take_awkward_rows(spark, clashing, awkward, labels_at):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, in each stage by itself."""
    at = labels_at([(6, 1, 0), (6, 1, 0), (7, 1, None), (5, None, 0), (8, 0, 0), (None, 1, 0)])
    docs = clashing([*awkward, (6, None), (None, None)])
    docs = docs.unionByName(docs.selectExpr("doc_id", "text", *[f"cast(null as {t}) as `{c}`" for c, t in docs.dtypes[2:]]))
    every = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, at)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        rows = Counter((r.doc_id, r.text) for r in kept.collect())
        assert set(rows) <= set(every), name
        if name != "near-dedup":
            assert not any(t is None or not t.strip() for _, t in rows), name
        if name == "near-dedup":
            assert max(n for (i, _), n in rows.items() if i is not None) == 1, name
            assert rows[None, awkward[0][1]] == every[None, awkward[0][1]], name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert sum(r.n_tokens for r in last if r.doc_id == 5) == 240_000
    assert Counter(r.doc_id for r in last if r.first_token == 0)[6] == 4


def test_stages_take_empty_tables(spark, clashing, labels_at):
    at = labels_at([])
    for rows in ([], [(1, None), (None, ""), (2, " ")]):
        docs = clashing(rows)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, at)
            assert got.count() == (len(rows) if name == "near-dedup" else 0), name
        docs.coalesce(1).write.mode("overwrite").parquet(f"{at}/documents.parquet")
        assert corpus_pipeline.run(spark, at).count() == 0


def test_ties_are_kept(spark, frame, labels_at):
    """Without trusted documents every score is 0.0, and with labels of one class every probability is 1.0."""
    rows = [(i, f"some words of text number {i} and more") for i in range(20)]
    assert corpus_pipeline.rules(spark, frame(rows), labels_at([(3, 0, 0)])).count() == 20


def test_packing_asks_for_every_word(spark, frame, small):
    """Words that would fill a query of 1,024 postings at once decide, too."""
    rng = np.random.default_rng(9)
    rows = [(i, t + " " + " ".join(rng.choice([f"f{k}" for k in range(40)], 12))) for i, t in test_packing.corpus(400, 5)]
    want = test_packing.brute(rows, packing.WINDOW, 10**9)
    assert want != test_packing.brute(rows, packing.WINDOW, 1024)
    assert sorted(test_packing.windows(corpus_pipeline.windows(spark, frame(rows).coalesce(1), small))) == want
