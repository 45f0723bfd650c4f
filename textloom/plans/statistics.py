"""Queries of histograms, impurity, confusion matrices, trees and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, confusion, joins, tree, windows
from ..streaming import windows as event_windows
from .registry import Tables, query

HIST = """
WITH c AS (SELECT CAST(trunc({v}) AS BIGINT) AS bin, count(*) AS n FROM {t} GROUP BY ALL), g AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin, sum(n) AS total FROM c)
SELECT bin, {n} AS n FROM g LEFT JOIN c USING (bin)"""


@query(HIST.format(v="l_quantity", t="lineitem", n="coalesce(n, 0)"))
def hist_quantity(t: Tables):
    return aggregates.integer_histogram(t.lineitem, "l_quantity")


@query(HIST.format(v="p_size", t="part", n="round(coalesce(n, 0) / total, 9)"))
def pmf_size(t: Tables):
    return aggregates.integer_histogram(t.part, "p_size", normalize=True).withColumn("n", F.round("n", 9))


@query(HIST.format(v="p_size", t="part", n="round(sum(coalesce(n, 0) / total) OVER (ORDER BY bin), 9)"))
def cmf_size(t: Tables):
    return aggregates.integer_histogram(t.part, "p_size", normalize=True, cumulative=True).withColumn("n", F.round("n", 9))


@query("""
SELECT least(floor((l_quantity - a) / ((b - a) / 7)) + 1, 7)::INTEGER AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_y FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) GROUP BY bin""")
def binned_mean(t: Tables):
    return aggregates.equal_width_bins(t.lineitem, "l_quantity", 7, "l_extendedprice").withColumn("mean_y", F.round("mean_y", 4))


@query("""
WITH s AS (SELECT ltrim(trim(CAST(o_custkey AS VARCHAR)), '0') AS s FROM orders), c AS (SELECT s, unnest(range(length(s))) AS i FROM s)
SELECT p::INTEGER AS position, round(avg(CASE WHEN substring(s, i + 1, 1) IN ('1', '2', '3') THEN 1 ELSE 0 END), 9) AS share FROM (SELECT s, i, unnest([i, i - length(s)]) AS p FROM c) GROUP BY p""")
def position_stats(t: Tables):
    return aggregates.position_stats(t.orders.select(F.col("o_custkey").cast("string").alias("s")), "s", valid="123").withColumn("share", F.round("share", 9))


@query("""
WITH p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)
SELECT round(-sum(p * log2(p)), 9) AS entropy, round(1 - sum(p * p), 9) AS gini, round(-sum(p * log2(p)) * (1 - sum(p * p)), 9) AS entropy_gini FROM p""")
def entropy_gini_event(t: Tables):
    e = aggregates.entropy_and_gini(t.events, "event_type")
    return e.select(*[F.round(c, 9).alias(c) for c in ("entropy", "gini", "entropy_gini")])


@query("SELECT event_type, round(var_pop(value), 6) AS variance, round(max(abs(value)) / max(abs(event_id)), 9) AS scale FROM events GROUP BY event_type")
def variance_event(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(aggregates.variance("value"), 6).alias("variance"), F.round(aggregates.best_scale("event_id", "value"), 9).alias("scale"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ols_price_qty(t: Tables):
    return t.lineitem.agg(*aggregates.regression("l_quantity", "l_extendedprice")).select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""
SELECT source, target, round(value, 9) AS value FROM (SELECT 1 AS source, 0 AS target, corr(l_extendedprice, l_quantity) AS value FROM lineitem UNION ALL SELECT 2, 0, corr(l_tax, l_quantity) FROM lineitem UNION ALL SELECT 2, 1, corr(l_tax, l_extendedprice) FROM lineitem) WHERE value > -0.5""")
def corr_edges(t: Tables):
    return aggregates.correlation_edges(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], -0.5).withColumn("value", F.round("value", 9))


PAIRS = "WITH l AS (SELECT l_returnflag AS actual, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS predicted FROM lineitem)"


def _pairs(t: Tables):
    return t.lineitem.select(F.col("l_returnflag").alias("actual"), F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R").alias("predicted"))


@query(f"""
{PAIRS}, k AS (SELECT DISTINCT actual AS x FROM l UNION SELECT DISTINCT predicted FROM l)
SELECT a.x AS actual, b.x AS predicted, count(l.actual) AS n FROM k a CROSS JOIN k b LEFT JOIN l ON l.actual = a.x AND l.predicted = b.x GROUP BY ALL""")
def confusion_counts(t: Tables):
    return confusion.confusion(_pairs(t), "actual", "predicted")


@query(f"""
{PAIRS}, k AS (SELECT DISTINCT actual AS label FROM l UNION SELECT DISTINCT predicted FROM l),
c AS (SELECT label, sum((actual = label AND predicted = label)::INT)::DOUBLE AS tp, sum((actual = label AND predicted <> label)::INT)::DOUBLE AS fn, sum((actual <> label AND predicted = label)::INT)::DOUBLE AS fp,
  sum((actual <> label AND predicted <> label)::INT)::DOUBLE AS tn, sum((actual <> label AND predicted = actual)::INT)::DOUBLE AS ok, count(*) AS n FROM k, l GROUP BY label)
SELECT label, round(tp / n, 9) AS accuracy, round(tp / (tp + fn), 9) AS sensitivity, round(ok / (ok + fp), 9) AS specificity, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc,
  round(((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))) ** 2 * n, 4) AS chi_squared, round(fn / (tp + fn), 9) AS false_positive, round(fn / (n - tp - fn), 9) AS false_negative FROM c""")
def confusion_stats(t: Tables):
    s = confusion.class_stats(confusion.confusion(_pairs(t), "actual", "predicted"))
    return s.select("label", *[F.round(c, 4 if c == "chi_squared" else 9).alias(c) for c in s.columns[1:]])


@query("""
WITH l AS (SELECT quality AS a, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT sum((a = 1 AND p = 1)::INT)::DOUBLE AS tp, sum((a = 0 AND p = 0)::INT)::DOUBLE AS tn, sum((a = 0 AND p = 1)::INT)::DOUBLE AS fp, sum((a = 1 AND p = 0)::INT)::DOUBLE AS fn, count(*)::DOUBLE AS samples FROM l)
SELECT '1' AS label, samples, tp, tn, fp, fn, round(tp / (tp + fn), 9) AS tpr, round(tn / (tn + fp), 9) AS tnr, round(fp / (fp + tn), 9) AS fpr, round((tp + tn) / samples, 9) AS accuracy FROM c""")
def binary_stats(t: Tables):
    pairs = t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("a"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("p"))
    s = confusion.binary_stats(confusion.confusion(pairs, "a", "p"), "1")
    return s.select("label", "samples", "tp", "tn", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("tpr", "tnr", "fpr", "accuracy")])


@query("""
WITH s AS (SELECT n_chars AS threshold, quality FROM labels JOIN documents USING (doc_id)), k AS (SELECT threshold, sum(quality)::BIGINT AS pos, (count(*) - sum(quality))::BIGINT AS neg FROM s GROUP BY threshold)
SELECT threshold, round((sum(pos) OVER () - sum(pos) OVER (ORDER BY threshold)) / sum(pos) OVER (), 9) AS sensitivity, round((sum(neg) OVER (ORDER BY threshold)) / sum(neg) OVER (), 9) AS specificity FROM k""")
def roc_curve(t: Tables):
    c = confusion.roc(t.labels.join(t.documents, "doc_id").select("n_chars", "quality"), "n_chars", "quality")
    return c.select("threshold", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


@query("""
SELECT round(avg(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) FILTER (WHERE quality = 1), 9) AS sensitivity, round(avg(CASE WHEN n_chars > 1000 THEN 0 ELSE 1 END) FILTER (WHERE quality = 0), 9) AS specificity FROM labels JOIN documents USING (doc_id)""")
def roc_threshold(t: Tables):
    s = confusion.at_threshold(t.labels.join(t.documents, "doc_id"), "n_chars", "quality", 1000)
    return s.select(F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


@query("""
WITH v AS (SELECT CAST(l_quantity AS INT) AS v, l_returnflag AS l FROM lineitem), d AS (SELECT DISTINCT v FROM v), n AS (SELECT l, count(*)::DOUBLE AS t FROM v GROUP BY l),
y AS (SELECT d.v, n.l, t, (SELECT count(*) FROM v WHERE v.v >= d.v AND v.l = n.l)::DOUBLE AS y FROM d, n),
s AS (SELECT v, sum(t) AS t, sum(y) AS y, sum(t - y) AS z, sum(t * ln(t)) AS tl, sum(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END) AS yl, sum(CASE WHEN t > y THEN (t - y) * ln(t - y) ELSE 0 END) AS zl FROM y GROUP BY v),
g AS (SELECT v, y::BIGINT AS n_yes, round(((ln(t) - tl / t) - y / t * (ln(y) - yl / y) - z / t * (ln(z) - zl / z)) / ln(2), 9) AS gain FROM s WHERE y > 0 AND z > 0)
SELECT v AS number, n_yes, gain FROM g""")
def split_gains(t: Tables):
    rows = t.lineitem.select("l_returnflag", F.col("l_quantity").cast("int").alias("quantity"))
    s = tree.split_scores(rows, "l_returnflag", ["quantity"])
    return s.select(F.col("number").cast("int").alias("number"), "n_yes", F.round("gain", 9).alias("gain"))


@query()
def tree_classes(t: Tables):
    """Labels by a tree of three levels, against the true ones."""
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("quantity"), (F.col("l_tax") * 100).cast("int").alias("tax"))
    node = tree.build(rows, "l_returnflag", ["l_linestatus", "quantity", "tax"], depth=3)
    return rows.groupBy("l_returnflag", tree.classified(node).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lagged, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM events")
def lag_padded(t: Tables):
    e = windows.lagged(t.events, "value", ["ts", "event_id"], 1, 0.0, ("user_id",))
    return windows.lagged(e, "value", ["ts", "event_id"], -2, -1.0, ("user_id",), "ahead").select("event_id", "lagged", "ahead")


@query("""
WITH r AS (SELECT event_id, user_id, value, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a.event_id, b.value AS lagged FROM r a JOIN r b ON a.user_id = b.user_id AND (b.r + 1) % b.n = a.r""")
def lag_circular(t: Tables):
    return windows.lagged_circular(t.events, "value", ["ts", "event_id"], 1, ("user_id",)).select("event_id", "lagged")


@query("""
SELECT event_id, array_to_string(w, ',') AS ids FROM (SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM events) WHERE len(w) = 3""")
def sliding_window3(t: Tables):
    w = windows.sliding(t.events.withColumn("id", F.col("event_id").cast("string")), "id", ["ts", "event_id"], 3, ("user_id",))
    return w.select("event_id", F.array_join("window", ",").alias("ids"))


@query("""
SELECT batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch, event_id FROM events) GROUP BY batch""")
def batches_of_100(t: Tables):
    b = windows.batches(t.events, "event_id", ["event_id"], 100)
    return b.select("batch", F.size("items").cast("bigint").alias("n"), F.array_min("items").alias("first"), F.array_max("items").alias("last"))


@query("""
WITH a AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS y FROM events GROUP BY ALL), b AS (SELECT CAST(o_orderdate AS DATE) AS day, min(o_totalprice) AS y FROM orders GROUP BY ALL),
s AS (SELECT CAST(day + INTERVAL 28 YEAR AS DATE) AS day, min(day) AS was, min_by(y, day) AS y FROM b GROUP BY 1)
SELECT a.day AS time, round(a.y, 4) AS y1, round(coalesce(s.y / 2, 0), 4) AS y2 FROM a LEFT JOIN s USING (day)""")
def align_daily(t: Tables):
    """Every day of the events with the least order of the same day 28 years before."""
    a = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    b = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min("o_totalprice").alias("y"))
    return joins.aligned(a, b, "day", "y", year_shift=28, scale=2.0).select("time", F.round("y1", 4).alias("y1"), F.round("y2", 4).alias("y2"))


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) AS t, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1, min(t) OVER (PARTITION BY user_id) AS f FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
e AS (SELECT user_id, min(t) AS f, max(t) AS l FROM s GROUP BY user_id), g AS (SELECT user_id, f + unnest(range(0, (l - f) // 21600000000 + 1)) * 21600000000 AS grid_t FROM e)
SELECT g.user_id, grid_t // 1000000 AS secs, round(v + coalesce((v1 - v) * ((grid_t - t) / (t1 - t)), 0), 6) AS value FROM g JOIN b ON g.user_id = b.user_id AND grid_t >= t AND (t1 IS NULL OR grid_t < t1)""")
def resample_6h(t: Tables):
    r = windows.resampled(t.events, "ts", "value", "6 hours", ("user_id",))
    return r.select("user_id", F.unix_seconds("ts").alias("secs"), F.round("value", 6).alias("value"))


@query("""
WITH u AS (SELECT (value - a) / (b - a) AS u, n FROM events, (SELECT min(value) AS a, max(value) AS b, count(*) AS n FROM events)), d AS (SELECT lead(u, 25) OVER w AS x, lead(u, 50) OVER w - u AS d, n FROM u WINDOW w AS (ORDER BY u)),
i AS (SELECT x, (50 / (n - 1)) / nullif(d, 0) AS y FROM d WHERE d IS NOT NULL)
SELECT count(*) + 2 AS n, round(max(x), 9) AS greatest_x, round(sum(y) / 1000, 4) AS total FROM i WHERE true""")
def density_summary(t: Tables):
    d = windows.adaptive_density(t.events, "value", 50)
    inner = F.when((F.col("x") > 0) & (F.col("x") < 1), F.col("x"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(inner), 9).alias("greatest_x"), F.round(F.sum(F.when((F.col("x") > 0) & (F.col("x") < 1), F.col("density"))) / 1000, 4).alias("total"))


@query("SELECT date_trunc('week', ts) AS period, count(*) AS n FROM events GROUP BY period")
def datetime_histogram(t: Tables):
    return aggregates.datetime_histogram(t.events, "ts", "week").select(F.col("period").cast("timestamp_ntz").alias("period"), "n")


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows_daily(t: Tables):
    w = event_windows.tumbling(t.events)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


SESSIONS = """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOURS AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s"""


@query(SESSIONS)
def user_sessions(t: Tables):
    s = event_windows.sessions(t.events)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


SLIDING = """
SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w, event_type, value FROM events) GROUP BY ALL"""


@query(SLIDING)
def event_windows_sliding(t: Tables):
    w = event_windows.sliding(t.events)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _streamed(t: Tables, build, mode: str):
    """What a stream that reads the events and ends leaves in the shared folder. build: from a stream to a stream."""
    import uuid

    from ..sources.folders import shared_folder

    name = f"streamed_{uuid.uuid4().hex}"
    events = event_windows.stream(t.spark, f"{t.folder}/event[s].parquet")  # a pattern, as the table may be a single file
    at = f"{shared_folder(t.spark)}/{name}"
    return event_windows.run_to_folder(build(events), f"{at}-rows", at, mode)


DAILY = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def _rounded(w, *keys: str):
    return w.select(*[F.col(k).cast("timestamp_ntz").alias(k) if k in ("start", "end") else F.col(k) for k in keys], "n", F.round("total", 4).alias("total"))


@query(DAILY)
def streamed_daily(t: Tables):
    """The daily windows by a stream."""
    return _rounded(_streamed(t, event_windows.tumbling, "complete"), "start", "event_type")


@query(SLIDING)
def streamed_sliding(t: Tables):
    """Windows of two days, one a day, by a stream."""
    return _rounded(_streamed(t, event_windows.sliding, "complete"), "start", "event_type")


@query(SESSIONS)
def streamed_sessions(t: Tables):
    """Sessions of each user by a stream, whose files may come in any order."""
    return _rounded(_streamed(t, lambda e: event_windows.sessions(e, late=None), "complete"), "start", "end", "user_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_distinct(t: Tables):
    """Users and event types without repeats: within the watermark by the stream, and of those that came again later."""
    return _streamed(t, lambda e: event_windows.deduplicated(e, "user_id", "event_type"), "append").select("user_id", "event_type").distinct()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counts(t: Tables):
    """Running counts kept as the stream's own state; the last of each type."""
    return _streamed(t, lambda e: event_windows.running_counts(e.select("event_type"), "event_type"), "update").groupBy("event_type").agg(F.max("n").alias("n"))


@query("SELECT a.event_id AS first, b.event_id AS second FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTES")
def streamed_pairs(t: Tables):
    """Events of a user within ten minutes: a stream joined with a table."""
    pairs = _streamed(t, lambda e: event_windows.joined(e, t.events, "user_id", "10 minutes").select(F.col("a.event_id").alias("first"), F.col("b.event_id").alias("second")), "append")
    return pairs.select("first", "second")
