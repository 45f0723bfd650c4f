"""Queries of scalar functions: strings, coercion, numbers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, dates, maths, strings
from .registry import Tables, query


@query("""
SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS name, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS slug,
  CASE WHEN length(n_name) > 5 THEN left(n_name, 5) || '...' ELSE n_name END AS short FROM nation""")
def identifier_names(t: Tables):
    n = F.col("n_name")
    return t.nation.select("n_nationkey", strings.identifier(n).alias("name"), strings.slug(n).alias("slug"), strings.truncate(n, 5).alias("short"))


@query("""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS field,
  left(regexp_replace(p_name, '[ :\\\\/?*&"<>|~`!]+', '-', 'g'), 60) AS file FROM part""")
def slug_names(t: Tables):
    return t.part.select("p_partkey", strings.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), strings.identifier(F.col("p_type")).alias("field"), strings.filename(F.col("p_name")).alias("file"))


@query("""
SELECT c_custkey, lpad(right(regexp_extract(c_name, '[^#]*$'), 10), 10, '0') AS serial, coalesce(try_cast(nullif(regexp_extract(c_name, '^[\\s+-]*([0-9]+)', 1), '') AS BIGINT), 0) AS first_digits FROM customer""".replace("\\\\", "\\"))
def serial_norm(t: Tables):
    return t.customer.select("c_custkey", strings.serial_number(F.col("c_name")).alias("serial"), coerce.first_digits(F.col("c_name")).alias("first_digits"))


@query("""
SELECT s_suppkey, cast(regexp_extract(x, '^([0-9]+)', 1) AS BIGINT) AS a, try_cast(nullif(regexp_extract(x, '^[0-9]+[^0-9]+([0-9]+)', 1), '') AS BIGINT) AS b FROM (SELECT s_suppkey, s_nationkey || '-' || s_suppkey AS x FROM supplier)""")
def int_pairs(t: Tables):
    p = coerce.int_pair(F.concat_ws("-", "s_nationkey", "s_suppkey"))
    return t.supplier.select("s_suppkey", p["first"].alias("a"), p["second"].alias("b"))


@query("""
SELECT o_orderkey, CASE WHEN length(z) = 4 THEN '0' || z WHEN length(z) IN (2, 3, 5) THEN z ELSE '' END AS zip FROM (SELECT o_orderkey, CAST(o_custkey % 100000 AS VARCHAR) AS z FROM orders)""")
def zip_norm(t: Tables):
    return t.orders.select("o_orderkey", coerce.postal_code((F.col("o_custkey") % 100000).cast("string")).alias("zip"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(value AS BIGINT) AS cut, coalesce(try_cast(event_type AS DOUBLE), -1) AS none FROM (SELECT event_id, props, trunc(value) AS value, event_type FROM events)""")
def tolerant_numbers(t: Tables):
    return t.events.select("event_id", coerce.to_float(F.get_json_object("props", "$.k")).alias("k"), coerce.to_int(F.col("value").cast("string")).alias("cut"), coerce.to_float(F.col("event_type"), -1.0).alias("none"))


@query("""
SELECT l_orderkey, l_linenumber, round(round(l_extendedprice / power(10, floor(log10(l_extendedprice)) - 2)) * power(10, floor(log10(l_extendedprice)) - 2), 4) AS price3,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio, round(l_extendedprice, -2) AS hundreds FROM lineitem""")
def round_and_divide(t: Tables):
    p = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(maths.round_significant(p, 3), 4).alias("price3"), F.round(maths.safe_div(F.col("l_tax"), F.col("l_discount"), None), 6).alias("ratio"), maths.round_place(p, -2).alias("hundreds"))


@query("""
SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163 AS day_number, strftime(o_orderdate, '%Y-%m-%d-%H-%M-%S') AS tag, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
  CAST(epoch(o_orderdate) AS BIGINT) AS secs, strftime(o_orderdate, '%Y.%m') AS short_tag, CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS millis FROM orders""")
def date_scalars(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", dates.ordinal(d).cast("bigint").alias("day_number"), dates.time_tag(d).alias("tag"), dates.quantize(d, 2).cast("date").alias("month_start"), dates.seconds(d).alias("secs"), dates.time_tag(d, ".", 2).alias("short_tag"), dates.milliseconds(d).alias("millis"))


@query("""
SELECT event_id, round(719163 + epoch_us(ts) / 86400000000.0, 8) AS day_float, round((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 86400000000.0, 8) AS since, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS second_of_day FROM events""")
def time_scalars(t: Tables):
    ts = F.col("ts")
    return t.events.select("event_id", F.round(dates.ordinal_float(ts), 8).alias("day_float"), F.round(dates.days_since(ts, F.lit("2020-01-01").cast("timestamp")), 8).alias("since"), dates.seconds_of_day(ts).cast("bigint").alias("second_of_day"))


@query("""
SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', make_date(year(o_orderdate), 1, 1)) AS BIGINT) * 86400 AS year_start, strftime(o_orderdate, '%-m/%-d/%Y') AS us, true AS us_ok, day(o_orderdate) <= 12 AS other_ok, false AS short_ok FROM orders""")
def epochs_and_checks(t: Tables):
    d = F.col("o_orderdate")
    us = F.date_format(d, "M/d/yyyy")
    return t.orders.select("o_orderkey", dates.epoch_seconds(F.year(d)).alias("year_start"), us.alias("us"), dates.is_american_date(us).alias("us_ok"), dates.is_american_date(F.date_format(d, "d/M/yyyy")).alias("other_ok"), dates.is_american_date(F.date_format(d, "M/d")).alias("short_ok"))


@query("""
SELECT p_partkey, split_part(p_type, ' ', 1) AS first_part, len(string_split(p_type, ' ')) AS parts, len(list_filter(string_split_regex(p_name, '[ aeiou]'), lambda x: x <> '')) AS consonant_runs FROM part""")
def split_parts(t: Tables):
    parts = strings.multisplit(F.col("p_type"), " ")
    return t.part.select("p_partkey", F.element_at(parts, 1).alias("first_part"), F.size(parts).cast("bigint").alias("parts"), F.size(strings.multisplit(F.col("p_name"), " aeiou", keep_blank=False)).cast("bigint").alias("consonant_runs"))


@query("""
WITH RECURSIVE f(n, a, b) AS (SELECT 1::BIGINT, 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 50)
SELECT p_size, a AS fib FROM (SELECT DISTINCT p_size FROM part) JOIN f ON p_size = n""")
def fibonacci_sizes(t: Tables):
    return t.part.select("p_size").distinct().where("p_size between 1 and 50").select("p_size", maths.fibonacci(F.col("p_size")).alias("fib"))
