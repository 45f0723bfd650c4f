"""Queries of maps, arrays, lines, shifted series and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths, tokens
from ..operators import aggregates, confusion, joins, reshape, tree, windows
from .registry import Tables, query


@query("""
SELECT p_partkey, p_name AS by_brand, 'name' AS key, 'none' AS no_key, p_type AS merged, p_brand AS kept, 'x' AS stripped, 2 AS n_stripped, p_name AS nested, p_brand AS nested_kept FROM part""")
def map_lookups(t: Tables):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    m = F.create_map(F.lit("name"), n, F.lit("brand"), b)
    new = F.create_map(F.lit("name"), k, F.lit("brand"), F.lit(None).cast("string"))
    blank = F.create_map(F.lit(" a "), F.lit("x"), F.lit(""), n, F.lit("b"), b)
    nested = reshape.merged_nested(F.create_map(F.lit("p"), F.create_map(F.lit("brand"), b)), F.create_map(F.lit("p"), F.create_map(F.lit("name"), n)))
    stripped = reshape.stripped_keys(blank)
    return t.part.select(
        "p_partkey", F.try_element_at(F.map_from_entries(F.transform(F.map_entries(reshape.inverted_map(F.create_map(n, F.concat(b, F.lit("!"))))), lambda e: F.struct(F.regexp_replace(e["key"], "!", ""), e["value"]))), b).alias("by_brand"),
        reshape.key_of(m, n, "none").alias("key"), reshape.key_of(m, F.lit("?"), "none").alias("no_key"), F.element_at(reshape.merged_maps(m, new), "name").alias("merged"), F.element_at(reshape.merged_maps(m, new), "brand").alias("kept"),
        F.element_at(stripped, "a").alias("stripped"), F.size(stripped).alias("n_stripped"), F.element_at(F.element_at(nested, "p"), "name").alias("nested"), F.element_at(F.element_at(nested, "p"), "brand").alias("nested_kept"),
    )


@query("""
SELECT p_partkey, a || ',' || b || ',' || b AS padded, a AS first, b AS second, b || ',' || a AS turned, '-,' || a AS moved, b || ',-' AS back, a || ';' || b AS transposed, 1.5 + p_size AS number, 'Part(''' || a || ''', ''' || p_size || ''')' AS shown
FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def array_shapes(t: Tables):
    w = F.split("p_name", " ")
    join = lambda a: F.array_join(a, ",")
    numbers = reshape.floats(F.array(F.array(F.concat((F.col("p_size") + 1).cast("string"), F.lit(".5")))))
    return t.part.select(
        "p_partkey", join(reshape.padded(w, 3)).alias("padded"), reshape.first(w).alias("first"), reshape.nested_item(w, 1, 1).alias("second"), join(windows.circular(w, 1)).alias("turned"), join(windows.shifted(w, 1, "-")).alias("moved"), join(windows.shifted(w, -1, "-")).alias("back"),
        reshape.joined(F.flatten(reshape.transposed_matrix(F.transform(w, lambda x: F.array(x)))), ";").alias("transposed"), numbers[0][0].alias("number"), reshape.representation("Part", w[0], F.col("p_size")).alias("shown"),
    )


@query("""SELECT s_suppkey || ';' || s_name || ';' || s_nationkey AS line, '{"key":' || s_suppkey || ',"name":"' || s_name || '"}' AS json FROM supplier""")
def supplier_lines(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("key"), F.concat(F.lit(" "), "s_name").alias("name"), "s_nationkey")
    clean = reshape.cleaned(s)
    lines = reshape.delimited_lines(clean, ";")
    both = reshape.json_row(clean.drop("s_nationkey"))
    key = F.regexp_extract("line", "^([0-9]+)", 1)
    return lines.withColumn("k", key).join(both.withColumn("k", F.regexp_extract("json", '"key":([0-9]+)', 1)), "k").select("line", "json")


@query("SELECT n_name AS nation, n_regionkey AS region FROM nation")
def named_columns(t: Tables):
    return reshape.selected_sorted(reshape.named(t.nation, "id, nation, region"))


@query("SELECT p_brand AS value, max(p_partkey) AS key FROM part GROUP BY p_brand UNION ALL SELECT p_type, max(p_partkey) FROM part GROUP BY p_type")
def inverted_attributes(t: Tables):
    return reshape.inverted_lists(t.part.select("p_partkey", F.array("p_brand", "p_type").alias("v")), "p_partkey", "v").select("value", "key")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN coalesce(lag(value) OVER w, -1) WHEN 'signup' THEN lead(value, 2) OVER w ELSE value END AS lagged FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def lagged_types(t: Tables):
    return windows.lagged_series(t.events, {"error": 1, "signup": -2}, {"error": -1.0}, "event_type", "event_id", "value").select("event_id", "lagged")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20' GROUP BY event_type")
def clipped_events(t: Tables):
    return windows.clipped(t.events, "ts", F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def pricing_rollup(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.countDistinct("l_partkey").alias("parts"))


@query("""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus), ())""")
def pricing_sets(t: Tables):
    sets = [[F.col("l_returnflag"), F.col("l_linenumber")], [F.col("l_linestatus")], []]
    return t.lineitem.groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).select("l_returnflag", "l_linestatus", "l_linenumber", "n")


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'neither', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)""")
def set_operations(t: Tables):
    o, c = t.orders.select("o_custkey"), t.customer.select(F.col("c_custkey").alias("o_custkey"))
    n = lambda d, name: d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(o.intersect(c), "both").unionAll(n(c.exceptAll(o.distinct()), "neither")).unionAll(n(o.union(c).distinct(), "either"))


@query("""
SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS around FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranked_orders(t: Tables):
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.rank().over(w.orderBy("o_orderpriority")).cast("bigint").alias("rank"), F.dense_rank().over(w.orderBy("o_orderpriority")).cast("bigint").alias("dense"), F.sum("o_orderkey").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-1, 1)).alias("around"))


@query("""
SELECT event_type, true AS near FROM events GROUP BY event_type""")
def approximate_users(t: Tables):
    """Whether the sketch's count is within a tenth of the exact one. Both are of the distinct pairs: beside a countDistinct each pair would have a sketch of its own."""
    n = t.events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count("user_id").alias("n"))
    return n.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n") + 1).alias("near"))


@query("""
SELECT i::INTEGER AS bin, p_size + i AS n, p_partkey FROM part, range(3) r(i)""")
def counts_by_place(t: Tables):
    h = aggregates.histogram_of_counts(F.array(*[F.col("p_size") + i for i in range(3)]))
    return t.part.select("p_partkey", F.explode(h).alias("h")).select("p_partkey", "h.bin", F.col("h.n").alias("n"))


@query("""
WITH c AS (SELECT sum((quality = 1 AND n_chars > 800)::INT)::DOUBLE AS tp, sum((quality = 0 AND n_chars <= 800)::INT)::DOUBLE AS tn, sum((quality = 0 AND n_chars > 800)::INT)::DOUBLE AS fp, sum((quality = 1 AND n_chars <= 800)::INT)::DOUBLE AS fn FROM labels JOIN documents USING (doc_id)),
m AS (SELECT *, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS phi FROM c)
SELECT round(phi, 9) AS phi, round(abs(phi) * sqrt(tp + tn + fp + fn), 6) AS chi, round(phi * phi * (tp + tn + fp + fn), 6) AS chi2 FROM m""")
def chi_of_counts(t: Tables):
    long, good = F.col("n_chars") > 800, F.col("quality") == 1
    counts = t.labels.join(t.documents, "doc_id").agg(*[F.count_if(c).alias(k) for k, c in (("tp", good & long), ("tn", ~good & ~long), ("fp", ~good & long), ("fn", good & ~long))])
    four = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    n = four[0] + four[1] + four[2] + four[3]
    return counts.select(F.round(maths.mcc(*four), 9).alias("phi"), F.round(maths.chi(maths.mcc(*four), n), 6).alias("chi"), F.round(maths.chi_squared_of_counts(*four), 6).alias("chi2"))


@query("SELECT count(*) AS n, true AS once FROM orders")
def split_orders(t: Tables):
    """Both parts of a random split together have every order once."""
    a, b = joins.random_split(t.orders, 0.3, "o_orderkey", seed=5)
    own = a.unionAll(b).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("times") == 1).alias("once"))


@query("""
WITH s AS (SELECT n_chars AS threshold, quality FROM labels JOIN documents USING (doc_id)), k AS (SELECT threshold, sum(quality)::BIGINT AS pos, (count(*) - sum(quality))::BIGINT AS neg FROM s GROUP BY threshold),
r AS (SELECT threshold, (sum(pos) OVER () - sum(pos) OVER (ORDER BY threshold)) / sum(pos) OVER () AS sensitivity, (sum(neg) OVER (ORDER BY threshold)) / sum(neg) OVER () AS specificity FROM k)
SELECT threshold, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity FROM r ORDER BY round(abs(specificity - 0.8), 12), threshold LIMIT 1""")
def threshold_of_specificity(t: Tables):
    curve = confusion.roc(t.labels.join(t.documents, "doc_id").select("n_chars", "quality"), "n_chars", "quality")
    return confusion.threshold_for(curve, 0.8).select("threshold", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


@query("""
SELECT event_id, lag(value, 1, -1.0) OVER w AS before, lead(value, 3) OVER w AS ahead FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def lag_of_all(t: Tables):
    """One sequence of all events, without a partition."""
    e = windows.lagged(t.events, "value", ["ts", "event_id"], 1, -1.0, name="before")
    return windows.lagged(e, "value", ["ts", "event_id"], -3, None, name="ahead").select("event_id", "before", "ahead")


@query("""
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT a.event_id, b.value AS lagged FROM r a JOIN r b ON (b.r + 2) % b.n = a.r""")
def circular_of_all(t: Tables):
    return windows.lagged_circular(t.events, "value", ["ts", "event_id"], 2).select("event_id", "lagged")


@query("""
SELECT event_id, array_to_string(w, ',') AS ids FROM (SELECT event_id, list(event_id) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS w FROM events) WHERE len(w) = 4""")
def sliding_of_all(t: Tables):
    e = t.events.withColumn("id", F.col("event_id").cast("string"))
    return windows.sliding(e, "id", ["ts", "event_id"], 4).select("event_id", F.array_join("window", ",").alias("ids"))


@query(r"""
SELECT conv_id, turn, len(p) AS n_parts, md5(array_to_string(p, '|')) AS digest FROM (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[.?!][^A-Za-z0-9_]+', chr(1) || '\0' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM conversations)""")
def sentence_parts(t: Tables):
    p = tokens.sentences(F.col("text"), keep=True)
    return t.conversations.select("conv_id", "turn", F.size(p).cast("bigint").alias("n_parts"), F.md5(F.array_join(p, "|")).alias("digest"))


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_quantity >= 25 THEN 'many' ELSE 'few' END AS label FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40""")
def classified_lines(t: Tables):
    """A tree of one split, applied to every line within bounds."""
    node = tree.Node("l_quantity", 25.0, True, yes=tree.Node(results={"many": 2}), no=tree.Node(results={"few": 1}))
    rows = windows.clipped(t.lineitem, "l_quantity", 10.0, 40.0)
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", tree.classified(node).alias("label"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '(?m)^#{1,6} '))::INTEGER AS headings, len(regexp_extract_all(text, '(?m)^[ \t]*[-*+] '))::INTEGER AS items, len(regexp_extract_all(text, '`[^`]+`'))::INTEGER AS code FROM documents""")
def markdown_counts(t: Tables):
    m = aggregates.markdown_stats(F.col("text"))
    return t.documents.select("doc_id", m["headings"].alias("headings"), m["items"].alias("items"), m["code"].alias("code"))
