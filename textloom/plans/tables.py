"""Queries that reshape, aggregate, sort and join tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import aggregates, joins, reshape
from .registry import Tables, query


@query("SELECT event_type, sum(user_id % 7)::BIGINT AS count FROM events GROUP BY event_type")
def consolidated_counts(t: Tables):
    return aggregates.consolidated_counts(t.events.select("event_type", (F.col("user_id") % 7).alias("count")), "event_type")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def dup_counts(t: Tables):
    return aggregates.duplicates(t.events, "user_id", "event_type")


@query("""
SELECT o_orderkey, name, value FROM (UNPIVOT (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders) ON o_custkey, o_orderstatus, o_orderpriority INTO NAME name VALUE value)""")
def unpivot_orders(t: Tables):
    o = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_orderpriority")
    return reshape.unpivoted(o, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
SELECT * FROM (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, 0 AS retail FROM supplier UNION ALL SELECT p_partkey, p_name, 0, p_retailprice FROM part)""")
def aligned_records(t: Tables):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("retail"))
    return reshape.aligned_records([a, b], 0)


@query("""
SELECT j, string_agg(x, ',' ORDER BY i) AS items FROM (SELECT p_partkey AS i, unnest(range(len(w)))::INTEGER AS j, unnest(w) AS x FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)) GROUP BY j""")
def transposed_words(t: Tables):
    rows = t.part.select("p_partkey", F.split("p_type", " ").alias("w"))
    return reshape.transposed_ragged(rows, "p_partkey", "w").select("j", F.array_join("values", ",").alias("items"))


@query("""
SELECT array_to_string([c_custkey::VARCHAR, c_mktsegment, c_name, c_nationkey::VARCHAR], ', ') AS key, c_acctbal AS stat FROM customer""")
def consolidated_stats(t: Tables):
    return reshape.consolidated_stats(t.customer, "c_acctbal")


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type")
def ordered_distinct(t: Tables):
    return joins.ordered_distinct(t.events, "event_id", "event_type")


@query("""
SELECT n_name, place FROM (SELECT n_name, row_number() OVER (ORDER BY coalesce(nullif(list_position(['un', 'ch', 'ja'], lower(left(n_name, 2))), 0), 4), n_name) AS place FROM nation)""")
def prefix_sort(t: Tables):
    from pyspark.sql import Window

    order = Window.orderBy(strings.prefix_order(F.col("n_name"), ["un", "ch", "ja"]), "n_name")
    return t.nation.select("n_name", F.row_number().over(order).cast("bigint").alias("place"))


@query("""
SELECT a.n_name AS query, b.n_name AS match, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS score
FROM nation a, nation b WHERE 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) >= 0.6""")
def fuzzy_nation_pairs(t: Tables):
    return joins.fuzzy_pairs(t.nation, t.nation, "n_name", "n_name", 0.6).select(F.col("key").alias("query"), F.col("other").alias("match"), F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT DISTINCT n_name || 'X' AS query FROM nation), s AS (
  SELECT query, n_name AS match, 1 - levenshtein(query, n_name) / greatest(length(query), length(n_name)) AS score FROM q, nation)
SELECT query, match, round(score, 6) AS score FROM q LEFT JOIN (
  SELECT query, match, score, row_number() OVER (PARTITION BY query ORDER BY score * sqrt(length(query) ** 2 / (length(match) ** 2 + length(query) ** 2)) DESC, match DESC) AS r FROM s WHERE score >= 0.6) USING (query) WHERE coalesce(r, 1) = 1""")
def fuzzy_nation(t: Tables):
    q = t.nation.select(F.concat("n_name", F.lit("X")).alias("q"))
    return joins.fuzzy_lookup(q, t.nation, "q", "n_name").withColumn("score", F.round("score", 6))


@query("""
WITH w AS (SELECT DISTINCT p_name AS token FROM part)
SELECT a.token AS a, b.token AS b, round(1 - levenshtein(a.token, b.token) / greatest(length(a.token), length(b.token)), 6) AS score FROM w a JOIN w b ON a.token < b.token
WHERE 1 - levenshtein(a.token, b.token) / greatest(length(a.token), length(b.token)) >= 0.9""")
def vocab_pairs(t: Tables):
    p = joins.fuzzy_pairs(t.part, t.part, "p_name", "p_name", 0.9).where("key < other")
    return p.select(F.col("key").alias("a"), F.col("other").alias("b"), F.round("score", 6).alias("score"))


@query()
def reduced_vocabulary(t: Tables):
    return joins.reduced_vocabulary(t.nation, "n_name", 0.5, longest_first=True)


@query("""
SELECT o_orderkey, o_totalprice >= 200000 AS dear FROM orders""")
def divided_orders(t: Tables):
    yes, no = joins.divided(t.orders, "o_totalprice", 200000)
    return yes.select("o_orderkey", F.lit(True).alias("dear")).union(no.select("o_orderkey", F.lit(False).alias("dear")))


@query("""
SELECT '| ' || array_to_string([CAST(CAST(trunc(s_acctbal) AS BIGINT) AS VARCHAR), s_name, s_suppkey::VARCHAR], ' | ') || ' |' AS line FROM supplier""")
def markdown_rows(t: Tables):
    s = t.supplier.select(F.col("s_acctbal").cast("bigint").alias("a"), "s_name", "s_suppkey")
    return reshape.markdown_lines(s)


@query("""
SELECT event_type, k AS prop, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def property_keys(t: Tables):
    return t.events.select("event_type", F.explode(F.json_object_keys("props")).alias("prop")).groupBy("event_type", "prop").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 4) AS avg_discount, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def pricing_cube(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def customers_without_orders(t: Tables):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT position, source, target, value::DOUBLE AS value FROM (VALUES (0, 0, 1, 5.0), (1, 1, 2, 4.0), (2, 2, 0, 2.5)) v(position, source, target, value)""")
def graph_edges(t: Tables):
    from ..operators import graphs

    text = t.spark.createDataFrame([(1, "Origin,3,9_Middle_5~Middle_End~End_Origin_2.5")], "id int, text string")
    return graphs.edges(text, "id", "text").select("position", F.col("source"), F.col("target"), "value")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def delimited_round_trip(t: Tables):
    """A table written with tabs and read again."""
    import uuid

    from ..sources import delimited
    from ..sources.folders import shared_folder

    path = f"{shared_folder(t.spark)}/nation-{uuid.uuid4().hex}.tsv"
    delimited.write(t.nation, path)
    return delimited.read(t.spark, path, "\t", normalize_names=True)


@query("""
SELECT (day + h * INTERVAL 1 HOUR)::TIMESTAMP AS ts, round(v, 4) AS value FROM (
  SELECT day, h, sum(value) FILTER (WHERE hour(ts) = h) AS v FROM (SELECT CAST(ts AS DATE) AS day, ts, value FROM events), (VALUES (9), (10)) x(h) GROUP BY ALL)""")
def flattened_hours(t: Tables):
    """A row for each day and a column for each of two hours, made long again."""
    hours = {f"{h:02}:00": F.sum(F.when(F.hour("ts") == h, F.col("value"))) for h in (9, 10)}
    wide = t.events.groupBy(F.to_date("ts").alias("date")).agg(*[v.alias(k) for k, v in hours.items()])
    return reshape.flattened_times(wide).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 4).alias("value"))


@query("SELECT epoch(o_orderdate)::DOUBLE AS o_orderdate, o_totalprice, NULL::DOUBLE AS o_orderstatus, o_custkey / 4.0 AS code FROM orders")
def quantified_orders(t: Tables):
    return reshape.quantified(t.orders.select("o_orderdate", "o_totalprice", "o_orderstatus", F.concat(F.lit(" "), (F.col("o_custkey") / 4).cast("string")).alias("code")))


@query("""
SELECT index, name, charge::DOUBLE AS charge, node_group FROM (VALUES (0, 'Origin', 3.0, 9), (1, 'Middle', 1.0, 0), (2, 'End', 1.0, 0)) v(index, name, charge, node_group)""")
def graph_nodes(t: Tables):
    from ..operators import graphs

    text = t.spark.createDataFrame([(1, "Origin,3,9_Middle_5~Middle_End~End_Origin_2.5")], "id int, text string")
    return graphs.nodes(text, "id", "text").drop("graph")
