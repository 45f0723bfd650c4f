"""Queries of names, coercions, labels and times that are written in many ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, dates, maths, strings, tokens
from ..functions import patterns as P
from ..operators import graphs, joins
from .registry import Tables, query


@query(r"""
SELECT p_partkey, p_name AS br, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name, '([a-zA-Z])[aeiou]+([a-zA-Z])', '\1\2', 'g'), '([a-zA-Z])[aeiou]+([a-zA-Z])', '\1\2', 'g'), '([a-zA-Z])[aeiou]+([a-zA-Z])', '\1\2', 'g'), ' ', '_', 'g') AS bare,
  p_type AS stripped, '"' || p_name || '" - x' AS plain FROM part""")
def cleaned_names(t: Tables):
    n = F.col("p_name")
    return t.part.select("p_partkey", strings.strip_br(F.concat(n, F.lit(" <BR />\n"))).alias("br"), strings.remove_internal_vowels(n, "_").alias("bare"), strings.strip_punctuation_and_space(F.concat(F.lit(" .("), "p_type", F.lit(")!\n"))).alias("stripped"), strings.transcode_lookalikes(F.concat(F.lit("“"), n, F.lit("” – ×é"))).alias("plain"))


@query("""
SELECT p_partkey, p_brand AS field, CASE WHEN p_type LIKE '%s' THEN p_type ELSE p_type || 's' END AS plural, p_name || '.csv' AS file, p_name || '|' || p_type AS names, p_name LIKE 'cold%' OR p_name LIKE 'small%' AS ignorable FROM part""")
def file_names(t: Tables):
    two = F.concat_ws("__", "p_type", "p_brand")
    return t.part.select(
        "p_partkey", strings.last_field(two).alias("field"), strings.plural_field(F.concat_ws("__", "p_brand", "p_type")).alias("plural"), strings.with_extension(F.concat("p_name", F.lit(".txt")), "csv").alias("file"),
        F.array_join(strings.names(F.concat("p_name", F.lit(" ,  "), "p_type")), "|").alias("names"), strings.is_ignorable(F.concat(F.lit("a/b/"), F.upper("p_name")), ["cold", "small"]).alias("ignorable"),
    )


@query("""
SELECT p_partkey, array_to_string([a || ' ' || b, a || ' y', 'x ' || b, 'x y'], '; ') AS readings FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def slash_readings(t: Tables):
    return t.part.select("p_partkey", F.array_join(strings.slash_product(F.concat(F.replace("p_name", F.lit(" "), F.lit("/x ")), F.lit("/y"))), "; ").alias("readings"))


@query("""
SELECT p_partkey, CASE WHEN length(a || ' ' || b) <= 10 THEN a || ' ' || b ELSE left(a, 10) END AS short, CASE p_type WHEN 'PROMO' THEN 'promo' ELSE p_type END AS abbreviated,
  upper(left(a, 1)) || substring(a, 2) || upper(left(b, 1)) || substring(b, 2) AS camel FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def short_names(t: Tables):
    n = F.col("p_name")
    return t.part.select("p_partkey", strings.shorten(n, 10).alias("short"), strings.abbreviate(F.col("p_type"), {"PROMO": "promo"}).alias("abbreviated"), strings.identifier(n, camel=True).alias("camel"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN false END AS flag, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, ascii(lower(o_orderstatus))::BIGINT AS code, (CASE WHEN o_orderkey % 100 < 70 THEN 2000 ELSE 1900 END + o_orderkey % 100)::INTEGER AS year,
  o_custkey * 1000::DOUBLE AS thousands, round(o_custkey * 0.01::DOUBLE, 6) AS share, o_custkey * 1000::DOUBLE AS scientific, o_custkey + 7.5::DOUBLE AS summed, o_custkey::BIGINT AS typed, -1::BIGINT AS missed FROM orders""")
def coerced_values(t: Tables):
    c = F.col("o_custkey").cast("string")
    return t.orders.select(
        "o_orderkey", coerce.to_bool(F.col("o_orderstatus")).alias("flag"), coerce.null_if_blank(F.when(F.col("o_custkey") % 3 == 0, " N/A ").otherwise(F.col("o_orderstatus"))).alias("status"), coerce.to_code(F.col("o_orderstatus")).alias("code"), coerce.year(F.concat(F.lit("'"), (F.col("o_orderkey") % 100).cast("string"))).alias("year"),
        coerce.financial(F.concat(F.lit("$ "), c, F.lit("k"))).alias("thousands"), F.round(coerce.financial(F.concat(c, F.lit(" percent"))), 6).alias("share"), coerce.to_float(F.concat(c, F.lit(" x 10^3"))).alias("scientific"), coerce.to_float(F.concat(c, F.lit("+7.5"))).alias("summed"),
        coerce.to_type(F.concat(F.lit(" "), c, F.lit(" ")), ["bigint"]).alias("typed"), coerce.to_type(F.col("o_orderstatus"), ["bigint"], F.lit(-1).cast("bigint")).alias("missed"),
    )


@query("""
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS numeric, CAST(date_trunc('month', o_orderdate) AS DATE) AS named, NULL::DATE AS wrong FROM orders""")
def label_dates(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", coerce.column_to_date(F.date_format(d, "M_yyyy")).alias("numeric"), coerce.column_to_date(F.lower(F.date_format(d, "MMM-yyyy"))).alias("named"), coerce.column_to_date(F.concat(F.lit("x_"), "o_orderstatus")).alias("wrong"))


@query("""
SELECT o_orderkey, s + 57600 AS closed, s - 32400 AS utc, CAST(o_orderdate AS DATE) AS day, s + 3600 AS later, CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch(make_date(year(o_orderdate), 1, 1)) AS BIGINT) ELSE s END AS epoch, (round((year(o_orderdate) - 1890) / 100.0) * 100)::INTEGER AS shift,
  CAST(o_orderdate AS DATE) AS us_date, s + 33300 AS wiki, s + 3661 AS written, s AS clipped, s AS by_ordinal, year(o_orderdate) || strftime(o_orderdate, '/%-m/%-d') AS loose_tag FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)""")
def written_times(t: Tables):
    d = F.col("o_orderdate").cast("timestamp")
    s = lambda c: F.unix_seconds(c.cast("timestamp"))
    return t.orders.select(
        "o_orderkey", s(dates.market_close(d)).alias("closed"), s(dates.to_utc(d, "jst")).alias("utc"), dates.from_day_ordinal(dates.ordinal(d)).alias("day"), s(dates.from_seconds(dates.seconds(d) + 3600)).alias("later"),
        s(dates.epoch_datetime(F.when(F.col("o_orderkey") % 2 == 0, F.year(d)).otherwise(dates.seconds(d)))).alias("epoch"), dates.century_shift(d, F.lit("1890-05-05").cast("date")).alias("shift"), dates.to_date(F.date_format(d, "M/d/yyyy")).alias("us_date"),
        s(dates.wiki_datetime(F.concat(F.lit("9:15, "), F.date_format(d, "d MMMM yyyy"), F.lit(" (UTC)")))).alias("wiki"), s(dates.to_datetime(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 01:01:01")))).alias("written"), s(dates.clip(d)).alias("clipped"), s(dates.from_ordinal(dates.ordinal_float(d))).alias("by_ordinal"), dates.time_tag(d, "/", 3, filled=False).alias("loose_tag"),
    )


@query("SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 AS twelve, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS day FROM events")
def clock_times(t: Tables):
    return t.events.select("event_id", dates.time_of_day(F.date_format("ts", "h:mm a")).cast("bigint").alias("twelve"), dates.time_of_day(F.date_format("ts", "HH:mm:ss")).cast("bigint").alias("day"))


@query("""
SELECT p_partkey, 'not' AS operator, p_name AS operand, p_size AS major, p_partkey % 10 AS minor, 3 AS patch, p_size AS minutes, p_name AS before, p_name LIKE '%widget%' AS has_widget FROM part""")
def parsed_phrases(t: Tables):
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    neg, ver, mins = P.negation(F.concat(F.lit("not "), n)), P.version_parts(F.concat(F.lit("__version__ = '"), size, F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".3'"))), P.minutes_in_parentheses(F.concat(n, F.lit("("), size, F.lit(" min) left")))
    return t.part.select("p_partkey", neg["operator"].alias("operator"), neg["operand"].alias("operand"), ver["major"].alias("major"), ver["minor"].cast("bigint").alias("minor"), ver["patch"].alias("patch"), mins["minutes"].alias("minutes"), mins["before"].alias("before"), P.has(n, "widget").alias("has_widget"))


@query(r"""
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '<[^>]*$', ''), '<[^>]*>|>', ' ', 'g'),
  '[^A-Za-z0-9_]*[ \t\n\r\f\v]''{1,3}|''{1,3}[^A-Za-z0-9_]+|[^A-Za-z0-9_.''-]+|[^A-Za-z0-9_]+[ \t\n\r\f\v]+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: length(x) BETWEEN 1 AND 256) AS w FROM documents)""")
def default_words(t: Tables):
    w = tokens.words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("""
SELECT p_size, CASE WHEN p_size = 1 THEN 1.0 ELSE power(10, ceil(log10(p_size))) END AS above, round(round(p_size / 10.0) * 10, 6) AS tens, 100.0 * power(10, ceil(log10(p_size))) AS more FROM (SELECT DISTINCT p_size FROM part)""")
def rounded_sizes(t: Tables):
    x = F.col("p_size").cast("double")
    return t.part.select("p_size").distinct().select("p_size", maths.round_significant(x, 0).alias("above"), maths.round_place(x, -1).alias("tens"), maths.round_significant(x, -2).alias("more"))


@query("""
SELECT r_regionkey AS id, 0 AS source, 1 AS target, r_regionkey + 0.5 AS value FROM region UNION ALL SELECT r_regionkey, 1, 0, 1.0 FROM region""")
def region_edges(t: Tables):
    """A graph of two edges for each region, from its text."""
    name = F.replace("r_name", F.lit(" "), F.lit(""))
    text = t.region.select("r_regionkey", F.concat(name, F.lit(",2,1_End_"), (F.col("r_regionkey") + 0.5).cast("string"), F.lit("~End_"), name, F.lit("_1")).alias("text"))
    return graphs.edges(text, "r_regionkey", "text").select(F.col("graph").alias("id"), "source", "target", "value")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'C-Plus-Plus' ELSE p_name END AS spelled, CASE WHEN p_size % 2 = 0 THEN 'datetime,date,date_time' ELSE '' END AS synonyms FROM part")
def spelled_words(t: Tables):
    even = F.col("p_size") % 2 == 0
    return t.part.select("p_partkey", joins.spelled(F.when(even, "C++").otherwise(F.col("p_name"))).alias("spelled"), F.array_join(joins.synonyms(F.when(even, " Time").otherwise(F.col("p_name"))), ",").alias("synonyms"))


@query("SELECT 'NATION_1' || r_regionkey AS query, 10 + r_regionkey AS value FROM region UNION ALL SELECT r_regionkey::VARCHAR, (list_sort(list(n_nationkey::VARCHAR))[1 + r_regionkey])::INTEGER AS value FROM nation, region GROUP BY r_regionkey")
def fuzzy_values(t: Tables):
    """Nations' keys by name, and by place in order of the names."""
    q = t.region.select(F.concat(F.lit("NATION_1"), "r_regionkey").alias("q")).unionAll(t.region.select(F.col("r_regionkey").cast("string")))
    return joins.fuzzy_value(q, t.nation, "q", "n_name", "n_nationkey")
