"""Joins that the plain ones don't cover: time series on shifted dates, and fuzzy keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import similarity
from ..functions.tokens import kmers
from .reshape import numbered

SYNONYMS = {"time": ["datetime", "date", "date_time"], "date": ["datetime", "time", "date_time"]}
#: Abbreviations and signs as words without punctuation.
SPELLINGS = {s: w for w, signs in {
    "C-Plus-Plus": "c++ C++", "C-Sharp": "C#", "Dot-Net": ".Net", "Javascript": "JS js", "plus-one": "+1", "bike": "o%o",
    "in my opinion": "IMO", "in my humble opinion": "IMHO", "be right back": "BRB", "out to lunch": "OTL", "out of the office": "OTO OOTO OOO",
    "what the freak": "WTF", "freaked out beyond recognition": "FUBAR", "heart": "<3", "broken-heart": "</3",
    "big-smile": ":-D :D", "tongue-out-smile": ":-P :P", "wink-smile": ";-) ;)", "smile": ":-)", "small-smile": ":)",
}.items() for s in signs.split()}


def aligned(left: DataFrame, right: DataFrame, time: str, value: str, year_shift: int = 0, monthly: bool = False, scale: float | None = 1.0, filler: float = 0.0) -> DataFrame:
    """time, y1 and y2: every row of the left series with the right series' value of that date (moved by years; on the
    first of its month if that is monthly) over a scale, the filler where there is none. Of equal dates the first in
    order of time and value counts. scale None: the greatest |y2| over the greatest |y1|, to one digit."""
    day = F.add_months(F.col(time).cast("date"), 12 * year_shift)
    day = F.trunc(day, "MM") if monthly else day
    once = right.select(day.alias("__day"), F.col(time).alias("__t"), F.col(value).cast("double").alias("__y")).groupBy("__day").agg(F.min(F.struct("__t", "__y"))["__y"].alias("__y"))
    own = left.select(F.col(time).alias("time"), F.col(value).cast("double").alias("y1"), F.col(time).cast("date").alias("__day"))
    joined = own.join(once, "__day", "left")
    if scale is None:
        tops = own.agg(F.max(F.abs("y1")).alias("a")).crossJoin(once.agg(F.max(F.abs("__y")).alias("b")))
        e = F.floor(F.log10(F.col("b") / F.col("a")))
        factor = F.when((F.col("a") == 0) | (F.col("b") == 0) | F.col("a").isNull() | F.col("b").isNull(), F.lit(1.0)).otherwise(F.round(F.col("b") / F.col("a") / F.pow(F.lit(10.0), e)) * F.pow(F.lit(10.0), e))
        joined = joined.crossJoin(F.broadcast(tops.select(factor.alias("__s"))))  # one row
        return joined.select("time", "y1", F.coalesce(F.col("__y") / F.col("__s"), F.lit(filler)).alias("y2"))
    return joined.select("time", "y1", F.coalesce(F.col("__y") / scale, F.lit(filler)).alias("y2"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, key: str, other: str, least: float = 0.85) -> DataFrame:
    """key, other and score of all pairs of distinct strings whose similarity is at least least (above 0).

    With at most d edits in m characters, strings share at least m - 1 - 2 d pairs of letters. As d <= (1 - least) m, a
    string of l letters shares (2 least - 1) l - 1 of them with each partner. So among each string's pairs of letters in
    order of rarity, but for the last so many less one, there is one that is also among its partner's, and only those are
    joined. Strings too short for that are joined by single letters, of which one at least is shared."""
    a = left.select(F.col(key).alias("key")).where(F.trim("key") != "").distinct()
    b = right.select(F.col(other).alias("other")).where(F.trim("other") != "").distinct()
    counted = lambda c, k: F.transform(kmers(c, k), lambda g, i: F.concat(g, F.lit(":"), F.size(F.filter(F.slice(kmers(c, k), 1, i + 1), lambda x: x == g)).cast("string")))

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        c, shared = F.col(name), F.ceil((2 * least - 1) * F.length(name) - 1 - 1e-9)
        return rows.select(name, F.greatest(shared, F.lit(0)).alias("shared"), F.explode(F.concat(counted(c, 2), F.when(shared < 1, F.array_distinct(F.split(c, ""))).otherwise(F.array().cast("array<string>")))).alias("g"))

    ga, gb = pieces(a, "key"), pieces(b, "other")
    rarity = ga.select("g").unionAll(gb.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def first(grams: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(name).orderBy("n", "g"))
        own = grams.join(rarity, "g").withColumn("place", place)
        return own.where((F.col("shared") < 1) | (F.col("place") <= F.length(name) - F.col("shared"))).select(name, "g")

    la, lb = F.length("key"), F.length("other")
    both = first(ga, "key").join(first(gb, "other"), "g").where(F.least(la, lb) >= least * F.greatest(la, lb)).select("key", "other").distinct()
    return both.withColumn("score", similarity(F.col("key"), F.col("other"))).where(F.col("score") >= least)


def fuzzy_lookup(queries: DataFrame, table: DataFrame, query: str, key: str, least: float = 0.6) -> DataFrame:
    """For each distinct query its best key: an equal one, else the most similar; of equals the highest. Blank queries have none.

    The score is weighed by the lengths: similarity times sqrt(lq^2 / (lk^2 + lq^2)), as a short key is a poor answer."""
    pairs = fuzzy_pairs(queries, table, query, key, least).withColumnsRenamed({"key": "query", "other": "match"})
    lq, lk = F.length("query").cast("double"), F.length("match").cast("double")
    rank = F.when(F.col("query") == F.col("match"), 2.0).when(F.trim("query") == F.trim("match"), 1.5).otherwise(F.col("score") * F.sqrt(lq * lq / (lk * lk + lq * lq)))
    best = pairs.groupBy("query").agg(F.max(F.struct(rank.alias("rank"), F.col("match"), F.col("score"))).alias("b")).select("query", F.col("b.match").alias("match"), F.col("b.score").alias("score"))
    return queries.select(F.col(query).alias("query")).distinct().join(best, "query", "left")


def composite_key(*parts: Column) -> Column:
    """Several keys as one, for fuzzy_lookup."""
    return F.concat_ws("|", *parts)


def reduced_vocabulary(tokens: DataFrame, token: str, least: float = 0.85, longest_first: bool = False, limit: int = 20) -> DataFrame:
    """head and synonyms: tokens are visited in an order (descending, or the longest first); each takes up to limit of
    the remaining ones that are at least that similar, the most similar first.

    Similar pairs come from fuzzy_pairs; the greedy pass runs within each connected group of pairs."""
    from functools import partial

    pairs = fuzzy_pairs(tokens, tokens, token, token, least).where("key <> other")
    groups = connected(pairs.select(F.col("key").alias("u"), F.col("other").alias("v")))
    own = pairs.join(groups, pairs["key"] == groups["node"]).select("root", "key", "other", "score")
    taken = own.groupBy("root").applyInPandas(partial(_greedy, longest_first=longest_first, limit=limit), "head string, synonyms array<string>")
    alone = tokens.select(F.col(token).alias("head")).where(F.trim("head") != "").distinct().join(groups, F.col("head") == F.col("node"), "left_anti")
    return taken.unionByName(alone.select("head", F.expr("cast(array() as array<string>)").alias("synonyms")))


def _greedy(group: pd.DataFrame, longest_first: bool, limit: int) -> pd.DataFrame:
    near: dict[str, list[tuple[float, str]]] = {}
    for key, other, score in zip(group["key"], group["other"], group["score"], strict=True):
        near.setdefault(key, []).append((-score, other))
    left, out = set(near), []
    for head in sorted(near, key=(lambda t: (len(t), t)) if longest_first else (lambda t: t), reverse=True):
        if head in left:
            left.discard(head)
            own = [t for _, t in sorted(near[head]) if t in left][:limit]
            left.difference_update(own)
            out.append((head, sorted(own, reverse=True)))
    return pd.DataFrame(out, columns=["head", "synonyms"])


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the lowest string of its group) for undirected edges u, v; results are checkpointed each round."""
    from ..sources.folders import settled

    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = settled(edges.select(ends.alias("e")).select("e.*").distinct())
    labels = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        low = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("low"))
        new = labels.join(low, labels["node"] == low["u"]).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("jump"))
        new = settled(new.join(jump, new["root"] == jump["at"], "left").select("node", "was", F.least("root", "jump").alias("root")))
        labels = new.select("node", "root")
        if new.where("was <> root").isEmpty():
            return labels


def synonyms(word: Column, table: dict[str, list[str]] | None = None) -> Column:
    """Synonyms of a word by a small table, an empty array where there are none."""
    w, out = F.lower(F.trim(word)), F.expr("cast(array() as array<string>)")
    for k, v in (SYNONYMS if table is None else table).items():
        out = F.when(w == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def spelled(word: Column, table: dict[str, str] | None = None) -> Column:
    """A word by a table of spellings; words that aren't in it stay."""
    pairs = SPELLINGS if table is None else table
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), word), word)


def fuzzy_value(queries: DataFrame, table: DataFrame, query: str, key: str, value: str, least: float = 0.6) -> DataFrame:
    """query and value: the value of each query's best key (of equal keys the greatest value), or where the query is a whole
    number n the n-th value in order of the keys (from 0, from the end if negative)."""
    once = table.groupBy(F.col(key).alias("key")).agg(F.max(value).alias("value"))
    q = queries.select(F.col(query).alias("query")).distinct().withColumn("place", F.trim("query").try_cast("bigint"))
    rows = numbered(once, [F.col("key")])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("place") < 0, F.col("place") + F.col("n")).otherwise(F.col("place"))
    by_place = q.where("place is not null").crossJoin(F.broadcast(n)).withColumn("row_id", place).join(rows, "row_id").select("query", "value")  # n is one row
    named = fuzzy_lookup(q.join(by_place, "query", "left_anti"), once, "query", "key", least)
    return by_place.unionByName(named.join(once, named["match"] == once["key"], "left").select("query", "value"))


def divided(table: DataFrame, field: str, target) -> tuple[DataFrame, DataFrame]:
    """Rows that match a target and the rest (with nulls): numbers and times by >=, collections by membership, others by equality."""
    c = F.col(field)
    if isinstance(target, (list, tuple, set, frozenset)):
        p = c.isin(*target)
    elif isinstance(target, str):
        p = c == target
    else:
        p = c >= target
    return table.where(p), table.where(~F.coalesce(p, F.lit(False)))


def random_split(table: DataFrame, share: float = 0.1, *keys: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts by a seeded hash of the keys, the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), *(keys or table.columns)), F.lit(1_000_000)) < int(share * 1_000_000)
    return table.where(u), table.where(~u)


def ordered_distinct(table: DataFrame, order: str, *columns: str) -> DataFrame:
    """Distinct rows of the columns with the first place of each in an order."""
    return table.groupBy(*columns).agg(F.min(order).alias("first"))


def top(table: DataFrame, n: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
