"""Histograms, counts, impurity and other aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consolidated_counts(table: DataFrame, field: str, count: str = "count") -> DataFrame:
    """Sums of a count by a field."""
    return table.groupBy(field).agg(F.sum(count).alias(count))


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def integer_histogram(table: DataFrame, value: str, fillers: tuple = (), normalize: bool = False, cumulative: bool = False, low: int | None = None, high: int | None = None) -> DataFrame:
    """bin and n for every whole number from the lowest to the highest value (cut towards zero), zeros too.

    low and high only narrow the range. normalize: shares of all values, also of those outside the range.
    cumulative: running sums from the first bin. The number of bins is that of the value range."""
    v = F.col(value).try_cast("double") if dict(table.dtypes)[value] == "string" else F.col(value).cast("double")
    usable = table.where(~F.col(value).isin(*fillers) if fillers else F.lit(True)).select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = usable.groupBy(F.col("v").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.sum("n").alias("total"))
    if low is not None:
        bounds = bounds.withColumn("a", F.greatest("a", F.lit(low).cast("bigint")))
    if high is not None:
        bounds = bounds.withColumn("b", F.least("b", F.lit(high).cast("bigint")))
    # The range is made in steps, so that no row holds all of it.
    steps = bounds.where("a <= b").select("b", "total", F.explode(F.sequence("a", "b", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.sqrt((F.col("b") - F.col("a")).cast("double"))).cast("bigint")))).alias("s"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.sqrt((F.col("b") - F.col("a")).cast("double"))).cast("bigint")).alias("step"))
    grid = steps.repartition("s").select(F.explode(F.sequence("s", F.least(F.col("s") + F.col("step") - 1, F.col("b")))).alias("bin"), "total")
    out = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "total")
    if normalize:
        out = out.withColumn("n", F.col("n") / F.col("total"))
    if cumulative:
        # One row for each bin.
        out = out.withColumn("n", F.sum("n").over(Window.orderBy("bin")))
    return out.select("bin", "n")


def histogram_of_counts(counts: Column) -> Column:
    """(bin, n) from an array of counts whose index is the bin."""
    return F.transform(counts, lambda n, i: F.struct(i.alias("bin"), n.alias("n")))


def equal_width_bins(table: DataFrame, x: str, bins: int = 5, y: str | None = None) -> DataFrame:
    """bin (from 1), n and, if y is given, mean_y, over bins of equal width from the least to the greatest x."""
    bounds = table.agg(F.min(x).cast("double").alias("__a"), F.max(x).cast("double").alias("__b"))
    both = table.crossJoin(F.broadcast(bounds))  # one row
    place = F.when(F.col("__a") == F.col("__b"), F.lit(1)).otherwise(F.least(F.floor((F.col(x) - F.col("__a")) / ((F.col("__b") - F.col("__a")) / bins)) + 1, F.lit(bins)))
    measures = [F.count(F.lit(1)).alias("n")] + ([F.avg(y).alias("mean_y")] if y else [])
    return both.where(F.col(x).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(*measures)


def position_stats(table: DataFrame, text: str, valid: str = "0123456789", left_pad: str = "0", right_pad: str = "") -> DataFrame:
    """Share of valid characters by position from the left (0, 1, ...) and from the right (-1, -2, ...), of strings long enough."""
    s = F.trim(F.col(text))
    s = F.ltrim(s, F.lit(left_pad)) if left_pad else s
    s = F.rtrim(s, F.lit(right_pad)) if right_pad else s
    chars = table.select(s.alias("s")).where(F.length("s") > 0).select(F.length("s").alias("len"), F.posexplode(F.split("s", "")).alias("i", "c")).where("c <> ''")
    quoted = valid.replace("\\", "\\\\").replace("'", "\\'")
    ok = F.expr(f"instr('{quoted}', c)") > 0
    both = chars.select(F.explode(F.array(F.col("i"), F.col("i") - F.col("len"))).alias("position"), ok.cast("int").alias("ok"))
    return both.groupBy("position").agg(F.avg("ok").alias("share"))


def best_scale(x: str, y: str) -> Column:
    """Aggregate: the greatest |y| over the greatest |x|, 1.0 where either is 0."""
    a, b = F.max(F.abs(F.col(x))), F.max(F.abs(F.col(y)))
    return F.when((a == 0) | (b == 0) | a.isNull() | b.isNull(), F.lit(1.0)).otherwise(b / a)


def variance(field: str) -> Column:
    """Aggregate: the population's variance, 0.0 without rows."""
    return F.coalesce(F.var_pop(field), F.lit(0.0))


def entropy_and_gini(table: DataFrame, field: str, *by: str, base: float = 2.0) -> DataFrame:
    """entropy, gini and their product of a field's distribution, over all rows or by groups."""
    counts = table.groupBy(*by, F.col(field).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    n, total = F.col("__n"), "__t"
    sums = counts.groupBy(*by).agg(F.sum("__n").alias(total), F.sum(n * F.ln(n.cast("double"))).alias("__nl"), F.sum(n.cast("double") * n).alias("__sq"))
    t = F.col(total)
    return sums.select(*by, ((F.ln(t.cast("double")) - F.col("__nl") / t) / math.log(base)).alias("entropy"), (1 - F.col("__sq") / (t.cast("double") * t)).alias("gini")).withColumn("entropy_gini", F.col("entropy") * F.col("gini"))


def regression(x: str, y: str) -> list[Column]:
    """Aggregates slope and intercept of the least squares line."""
    return [F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept")]


def correlation_edges(table: DataFrame, columns: list[str], threshold: float = 0.5, gain: float = 1.0) -> DataFrame:
    """source, target (indices) and value of all pairs of columns whose correlation times gain is above the threshold."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    row = table.agg(*[F.corr(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("source"), F.lit(j).alias("target"), F.col(f"c_{i}_{j}").alias("value")) for i, j in pairs])).alias("e")).select("e.*")
    return long.where(F.col("value") * gain > threshold)


def correlation_graph_json(table: DataFrame, columns: list[str], threshold: float = 0.5, gain: float = 1.0) -> DataFrame:
    """One row of JSON with nodes and links."""
    edges = correlation_edges(table, columns, threshold, gain)
    links = edges.agg(F.array_sort(F.collect_list(F.struct("source", "target", "value"))).alias("links"))
    return links.select(F.to_json(F.struct(F.array(*[F.struct(F.lit(c).alias("name")) for c in columns]).alias("nodes"), "links")).alias("json"))


#: Distinct tokens whose frequencies are broadcast at most (some 60 bytes each).
BROADCAST_TOKENS = 2_000_000


def term_scores(tokens: DataFrame, doc: str, token: str, docs: DataFrame | None = None) -> DataFrame:
    """tf-idf: doc, token, tf, df and tfidf = tf ln(N / df) of rows of tokens. docs: the documents that have tokens (column doc), where that is cheaper than from the tokens.

    Tokens that are already partitioned by doc aren't shuffled again but for the sums of document frequencies.

    Document frequencies are broadcast if there are few enough tokens; beyond that a token's rows are salted by document,
    so that a frequent token isn't in one task."""
    from ..sources.folders import settled

    tf = tokens.groupBy(F.col(doc).alias("doc"), F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("tf"))
    df = settled(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    n = (tokens if docs is None else docs).agg(F.countDistinct(doc).alias("n"))
    if df.count() <= BROADCAST_TOKENS:
        both = tf.join(F.broadcast(df), "token")
    else:
        salt = F.pmod(F.xxhash64("doc"), F.lit(16))
        both = tf.withColumn("salt", salt).join(df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>"))), ["token", "salt"])
    return both.crossJoin(F.broadcast(n)).select("doc", "token", "tf", "df", (F.col("tf") * F.ln(F.col("n") / F.col("df"))).alias("tfidf"))


def vocabulary_similarity(a: DataFrame, b: DataFrame, doc: str, token: str) -> DataFrame:
    """Share of each document's distinct tokens (a: doc, token) that are in b's vocabulary (token)."""
    own = a.select(F.col(doc).alias("doc"), F.col(token).alias("token")).distinct()
    known = b.select(F.col(token).alias("token")).distinct().withColumn("known", F.lit(1))
    return own.join(known, "token", "left").groupBy("doc").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("known").alias("n_shared"), F.avg(F.coalesce("known", F.lit(0))).alias("share"))


def datetime_histogram(table: DataFrame, ts: str, unit: str = "day") -> DataFrame:
    return table.groupBy(F.date_trunc(unit, F.col(ts)).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def unique_tags(table: DataFrame, doc: str, text: str, k: int = 4) -> DataFrame:
    """For each text the k-mer that occurs in the fewest texts, the lowest of equals."""
    from ..functions.tokens import kmer_set

    own = table.select(F.col(doc).alias("doc"), F.explode(kmer_set(F.col(text), k)).alias("kmer"))
    df = own.groupBy("kmer").agg(F.count(F.lit(1)).alias("df"))
    return own.join(df, "kmer").groupBy("doc").agg(F.min(F.struct("df", "kmer")).alias("m")).select("doc", F.col("m.kmer").alias("tag"), F.col("m.df").alias("df"))


def markdown_stats(text: Column) -> Column:
    """Numbers of headings, list items, links and code marks."""
    return F.struct(
        F.regexp_count(text, F.lit(r"(?m)^#{1,6} ")).alias("headings"),
        F.regexp_count(text, F.lit(r"(?m)^\s*[-*+] ")).alias("items"),
        F.regexp_count(text, F.lit(r"\[[^\]]*\]\([^)]*\)")).alias("links"),
        F.regexp_count(text, F.lit("`[^`]+`")).alias("code"),
    )
