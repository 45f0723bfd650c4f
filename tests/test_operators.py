from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textloom.operators import aggregates, boundaries, confusion, graphs, joins, reshape, tree, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_histogram_goldens(spark):
    v = spark.createDataFrame([(x,) for x in (9, 7, 4, 2, 1, 1, 3, 7, 1, 2, 5, 4, 1, 2, 1)], "v int")
    assert rows(aggregates.integer_histogram(v, "v"), "bin") == [(1, 5), (2, 3), (3, 1), (4, 2), (5, 1), (6, 0), (7, 2), (8, 0), (9, 1)]
    assert rows(aggregates.integer_histogram(v, "v", low=3, high=5, cumulative=True), "bin") == [(3, 1), (4, 3), (5, 4)]
    assert aggregates.integer_histogram(v.limit(0), "v").count() == 0


@pytest.fixture(scope="module")
def animals(spark):
    counts = {("Cat", "Cat"): 5, ("Cat", "Dog"): 3, ("Dog", "Cat"): 2, ("Dog", "Dog"): 3, ("Dog", "Rabbit"): 1, ("Rabbit", "Dog"): 2, ("Rabbit", "Rabbit"): 11}
    pairs = [(a, p) for (a, p), n in counts.items() for _ in range(n)]
    return confusion.confusion(spark.createDataFrame(pairs, "actual string, predicted string"), "actual", "predicted")


def test_confusion_goldens(animals):
    assert animals.count() == 9 and animals.agg(F.sum("n")).first()[0] == 27
    b = confusion.binary_stats(animals, "Cat").first()
    assert b.tpr == pytest.approx(0.625) and b.fpr == pytest.approx(0.105263, abs=1e-6) and b.fnr == pytest.approx(0.75)
    c = {r.label: r for r in confusion.class_counts(animals).collect()}["Rabbit"]
    assert (c.tp, c.tn, c.fp, c.fn) == (11, 13, 1, 2)
    s = {r.label: r for r in confusion.class_stats(animals).collect()}
    assert s["Rabbit"].mcc == pytest.approx(0.779017, abs=1e-6)
    assert confusion.positive_label(["Cat", "Dog", "Rabbit"]) == "Cat" and confusion.positive_label(["N", "P"]) == "P"
    assert confusion.as_pairs(animals).count() == 27
    assert "Rabbit" in confusion.stats_json(animals).first().json
    assert confusion.displayed(animals).count() == 3


def test_sensitivity_goldens(spark):
    pairs = list(zip("ABC" * 5 + "CCC", "ABCBCACABCACCBCCCC", strict=True))
    s = {r.label: r for r in confusion.class_stats(confusion.confusion(spark.createDataFrame(pairs, "a string, p string"), "a", "p")).collect()}
    assert [s[k].sensitivity for k in "ABC"] == pytest.approx([0.2, 0.4, 0.75])
    assert [s[k].mcc for k in "ABC"] == pytest.approx([-0.033150, 0.265197, 0.35], abs=1e-5)


def test_roc(spark):
    t = spark.createDataFrame([(i / 10, int(i >= 5)) for i in range(10)], "score double, label int")
    curve = {round(r.threshold, 1): (r.sensitivity, r.specificity) for r in confusion.roc(t, "score", "label").collect()}
    for x in curve:
        one = confusion.at_threshold(t, "score", "label", x).first()
        assert curve[x] == pytest.approx((one.sensitivity, one.specificity))
    assert confusion.threshold_for(confusion.roc(t, "score", "label"), 1.0).first().threshold == pytest.approx(0.4)
    assert confusion.inverse(lambda x: x * x, 9, 0, 10) == pytest.approx(3)


#: Visits by the service that was bought: pages, whether the FAQ was read, country and referrer.
VISITS = {
    "Basic": [(21, "no", "UK", "(direct)"), (12, "yes", "New Zealand", "digg"), (18, "yes", "UK", "google"), (19, "yes", "France", "kiwitobes"), (23, "yes", "France", "kiwitobes"), (24, "yes", "USA", "digg")],
    "None": [(12, "no", "New Zealand", "(direct)"), (18, "no", "USA", "digg"), (18, "no", "UK", "google"), (19, "no", "UK", "kiwitobes"), (21, "no", "UK", "slashdot"), (18, "yes", "USA", "slashdot"), (19, "yes", "France", "slashdot")],
    "Premium": [(21, "no", "UK", "google"), (24, "no", "USA", "google"), (23, "yes", "France", "google")],
}


@pytest.fixture(scope="module")
def visits(spark):
    return spark.createDataFrame([(r, c, f, p, service) for service, own in VISITS.items() for p, f, c, r in own], "referrer string, country string, faq string, pages int, service string")


def test_impurity_goldens(visits):
    r = aggregates.entropy_and_gini(visits, "service").first()
    assert r.entropy == pytest.approx(1.50524, abs=1e-5) and r.gini == pytest.approx(0.6328125)
    assert rows(aggregates.entropy_and_gini(visits, "service", "faq").select("faq", F.round("gini", 6)), "faq") == [("no", 0.53125), ("yes", 0.53125)]


def test_tree(visits):
    node = tree.build(visits, "service", ["referrer", "country", "faq", "pages"])
    assert (node.column, node.value) == ("referrer", "google")
    assert tree.classify({"referrer": "google", "pages": 23}, node).keys() == {"Premium"}
    wrong = visits.where(tree.classified(node) != F.col("service")).count()
    assert wrong == 0 and tree.width(node) >= 5 and tree.depth(node) >= 3
    blend = tree.classify({"pages": 23, "country": "France", "faq": "yes"}, node)
    assert sum(blend.values()) > 0 and len(blend) > 1
    assert "referrer == google?" in tree.text(node)
    assert tree.width(tree.prune(node, 10.0)) == 1 and tree.width(tree.prune(node, 0.0)) == tree.width(node)


def test_regression_goldens(spark):
    y = [20.5, 21.0]
    homes = spark.createDataFrame(list(enumerate(y)), "x int, y double").agg(*aggregates.regression("x", "y")).first()
    assert (homes.slope, homes.intercept) == pytest.approx((0.5, 20.5))


def test_series_windows(spark):
    v = spark.createDataFrame(list(enumerate((3, 1, 4, 1, 5, 9, 2, 6, 5, 3))), "pos int, v int")
    got = [r.lagged for r in windows.lagged_circular(v, "v", ["pos"], 1).orderBy("pos").collect()]
    assert got == [3, 3, 1, 4, 1, 5, 9, 2, 6, 5]
    assert [r.lagged for r in windows.lagged(v, "v", ["pos"], -2, 0).orderBy("pos").collect()] == [4, 1, 5, 9, 2, 6, 5, 3, 0, 0]
    arrays = spark.range(1).select(windows.circular(F.array(*map(F.lit, (1, 2, 3))), 1).alias("c"), windows.shifted(F.array(*map(F.lit, (1, 2, 3))), 1, 0).alias("s"), windows.shifted(F.array(*map(F.lit, (1, 2, 3))), -2, 0).alias("l")).first()
    assert (arrays.c, arrays.s, arrays.l) == ([3, 1, 2], [0, 1, 2], [3, 0, 0])
    assert rows(windows.batches(v, "v", ["pos"], 4), "batch") == [(0, [3, 1, 4, 1]), (1, [5, 9, 2, 6]), (2, [5, 3])]
    assert rows(windows.batches(v, "v", ["pos"], 4, start=2), "batch") == [(2, [5, 3])]
    assert windows.sliding(v, "v", ["pos"], 3).count() == 8
    assert windows.clipped(v, "pos", 2, 4).count() == 3
    series = spark.createDataFrame([(s, p, 10 * s + p) for s in range(3) for p in range(3)], "series int, pos int, v int")
    moved = rows(windows.lagged_series(series, {1: 1, 2: -1}, {1: 0}).select("series", "pos", "lagged"), "series", "pos")
    assert [x for *_, x in moved] == [0, 1, 2, 0, 10, 11, 21, 22, None]


def test_resampling(spark):
    t0 = dt.datetime(2020, 1, 1)
    s = spark.createDataFrame([(t0, 0.0), (t0 + dt.timedelta(hours=4), 8.0), (t0 + dt.timedelta(hours=5), 0.0)], "t timestamp_ntz, v double")
    got = [(r.ts.hour, r.value) for r in windows.resampled(s, "t", "v", "2 hours").orderBy("ts").collect()]
    assert got == [(0, 0.0), (2, 4.0), (4, 8.0)]


def test_alignment(spark):
    day = lambda d: dt.date(2020, 1, d)
    a = spark.createDataFrame([(day(i), float(i)) for i in (1, 2, 3)], "t date, y double")
    b = spark.createDataFrame([(day(2), 200.0), (day(2), 999.0), (dt.date(2019, 1, 3), 300.0)], "t date, y double")
    assert rows(joins.aligned(a, b, "t", "y", scale=100.0).select("y1", "y2"), "y1") == [(1.0, 0.0), (2.0, 2.0), (3.0, 0.0)]
    assert rows(joins.aligned(a, b, "t", "y", year_shift=1).select("y1", "y2"), "y1") == [(1.0, 0.0), (2.0, 0.0), (3.0, 300.0)]
    assert joins.aligned(a, b, "t", "y", scale=None).count() == 3


def test_fuzzy(spark):
    words = spark.createDataFrame([(w,) for w in ("honey", "money", "phone", "ones", "one", " ", "xyz")], "w string")
    q = spark.createDataFrame([(w,) for w in ("hone", "money", "zzzz", " ")], "q string")
    got = dict(rows(joins.fuzzy_lookup(q, words, "q", "w").select("query", "match")))
    assert got["money"] == "money" and got["hone"] == "one" and got["zzzz"] is None and got[" "] is None
    vocab = {r.head: r.synonyms for r in joins.reduced_vocabulary(words, "w", 0.75).collect()}
    assert vocab["xyz"] == [] and vocab["money"] == ["honey"] and vocab["ones"] == ["one"]
    assert sorted([*vocab, *(s for v in vocab.values() for s in v)]) == sorted(w for w in ("honey", "money", "phone", "ones", "one", "xyz"))
    assert spark.range(1).select(joins.synonyms(F.lit(" Date ")).alias("s")).first().s == ["datetime", "time", "date_time"]
    assert [r.s for r in spark.createDataFrame([("c++",), (":-P",), ("cat",)], "w string").select(joins.spelled(F.col("w")).alias("s")).collect()] == ["C-Plus-Plus", "tongue-out-smile", "cat"]


@pytest.mark.parametrize("least", [0.5, 0.6, 0.75, 0.85])
def test_no_fuzzy_pair_is_lost(spark, least):
    import random

    r = random.Random(int(least * 100))
    words = sorted({"".join(r.choice("abx") for _ in range(r.randrange(1, 9))) for _ in range(150)} | {"abcd", "bad", "xbyd", "an", "on"})
    t = spark.createDataFrame([(w,) for w in words], "w string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in words for b in words if 1 - edits(a, b) / max(len(a), len(b)) >= least}
    assert {(p.key, p.other) for p in joins.fuzzy_pairs(t, t, "w", "w", least).collect()} == want


def test_fuzzy_values(spark):
    t = spark.createDataFrame([("seller", 2), ("sailor", 5), ("camera", 7)], "k string, v int")
    q = spark.createDataFrame([("sailer",), ("1",), ("-1",), ("zzz",)], "q string")
    got = dict(rows(joins.fuzzy_value(q, t, "q", "k", "v").select("query", "value")))
    assert got == {"sailer": 5, "1": 5, "-1": 2, "zzz": None}


def test_division(spark):
    t = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    yes, no = joins.divided(t, "x", 3)
    assert rows(yes) == [(5,)] and no.count() == 2
    a, b = joins.random_split(spark.range(10_000).toDF("id"), 0.3, "id")
    assert a.count() + b.count() == 10_000 and abs(a.count() - 3000) < 200


def test_reshaping(spark):
    ragged = spark.createDataFrame([(0, [1, 2]), (1, [3, 4, 5]), (2, [6])], "i int, row array<int>")
    assert rows(reshape.transposed_ragged(ragged, "i", "row"), "j") == [(0, [1, 3, 6]), (1, [2, 4]), (2, [5])]
    m = spark.createDataFrame([([[1, 2], [3, 4, 5], [6]],)], "m array<array<int>>")
    assert m.select(reshape.transposed_matrix(F.col("m"), 0).alias("t")).first().t == [[1, 3, 6], [2, 4, 0], [0, 5, 0]]
    maps = spark.createDataFrame([({"a": "x", " b ": "y", "": "z"}, {"a": "q", "c": None})], "m map<string,string>, n map<string,string>")
    r = maps.select(reshape.stripped_keys(F.col("m")).alias("k"), reshape.inverted_map(F.col("m")).alias("i"), reshape.merged_maps(F.col("m"), F.col("n")).alias("g"), reshape.key_of(F.col("m"), F.lit("y"), "none").alias("y"), reshape.key_of(F.col("m"), F.lit("?"), "none").alias("n"), reshape.simplified_params(F.col("n"), ("zz",)).alias("p")).first()
    assert r.k == {"a": "x", "b": "y"} and r.i == {"x": "a", "y": " b ", "z": ""} and r.g["a"] == "q" and r.y == " b " and r.n == "none" and r.p == {"a": "q"}
    wide = spark.createDataFrame([("2020-01-01", 1.0, 2.0, "n"), ("2020-01-02", 3.0, None, "n")], "`the date` string, `09:00` double, `09:15` double, note string")
    flat = rows(reshape.flattened_times(wide).select(F.unix_seconds("ts").alias("s"), "value"), "s")
    assert [v for _, v in flat] == [1.0, 2.0, 3.0, None] and flat[1][0] - flat[0][0] == 900
    assert reshape.normalized_columns(spark.createDataFrame([(1, 2, 3)], "`A b` int, `a-b` int, `` int")).columns == ["a_b", "a_b_2", "column"]
    arr = spark.createDataFrame([([1, 2],)], "a array<int>").select(reshape.padded(F.col("a"), 4).alias("p"), reshape.nested_item(F.col("a")).alias("f"), reshape.nested_item(F.col("a"), 1, 9).alias("n")).first()
    assert (arr.p, arr.f, arr.n) == ([1, 2, 2, 2], 1, None)
    assert reshape.records(spark, [{"a": 1}, {"b": 2}, {}]).count() == 2
    assert rows(reshape.quantified(spark.createDataFrame([(" 1.25 ", "x")], "a string, b string"), 1)) == [(1.3, None)]
    numbered = reshape.numbered(spark.range(1000).repartition(7), [F.desc("id")])
    assert numbered.where("row_id <> 999 - id").count() == 0 and numbered.count() == 1000


def test_graph_language(spark):
    g = spark.createDataFrame([(1, "Origin,3,9_I_5.6~Origin_II~I_III")], "id int, s string")
    assert rows(graphs.nodes(g, "id", "s").select("index", "name", "charge", "node_group"), "index") == [(0, "Origin", 3.0, 9), (1, "I", 1.0, 0), (2, "II", 1.0, 0), (3, "III", 1.0, 0)]
    assert rows(graphs.edges(g, "id", "s").select("source", "target", "value"), "source", "target") == [(0, 1, 5.6), (0, 2, 4.0), (1, 3, 4.0)]


def test_boundaries(spark):
    gold = [["Mr. Smith went home.", "He slept!", "Then e.g. nothing happened."], ["Dr. Jones and Mr. Brown met.", "They talked.", "Was it good?"], ["He paid $3.50 to Mr. Green.", "It rained."]]
    d = boundaries.train(gold, epochs=30)
    for doc in gold:
        assert d.segments(" ".join(doc)) == doc
    t = spark.createDataFrame([(" ".join(gold[0]), gold[0])], "text string, sentences array<string>")
    assert t.select(boundaries.segmented(F.col("text"), d).alias("s")).first().s == gold[0]
    assert {(r.gold, r.predicted) for r in boundaries.evaluated(t, "sentences", d).collect()} == {(True, True), (False, False)}
    assert boundaries.Detector().segments("One sentence here. Another one! done") == ["One sentence here.", "Another one!", "done"]
    assert boundaries.Detector().segments(None) == []
