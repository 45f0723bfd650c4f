"""Mixing overlapping sources to target weights by min-cost flow.

A source is a predicate over the documents' columns; a document may belong to
several. Documents are aggregated by membership pattern. In a flow network
each pattern supplies its tokens once for every copy that may be made, the
k-th copy at cost k a token (so costs are convex and copies fill in order);
tokens flow from a pattern to the sources it belongs to, and from a source to
the sink up to its quota, its weight's share of the budget. The cheapest
largest flow says how many tokens of each pattern count for each source.

Documents are then selected by a seeded hash: the hash range of a pattern is
cut where the running total of tokens comes nearest to the flow. The cuts come
from histograms of 2**12 ranges, refined once where a cut falls, and there are
at most a few for each pattern, so selection is a look-up in a small table and
no document is shuffled.

Tokens are words. Cases: a predicate that gives null counts as false; a
document of no source, or of no tokens, is not selected. Equal rows have equal
hashes and are selected together. A null doc_id counts as any other value.
Very long texts count whole and are selected whole. Where two cuts are equally
near the lower is taken. Quotas beyond what copies can supply stay unfilled;
weights need not add up to 1. No documents, or no tokens, give no rows. Extra
columns stay as they are; predicates see all columns by name, of those whose
names differ by case only the first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import lexical
from .frames import positional, place, settled

#: Names, SQL predicates over columns, and weights.
SOURCES = [
    ("english", "lang = 'en'", 0.30),
    ("german", "lang = 'de'", 0.12),
    ("spanish", "lang = 'es'", 0.10),
    ("french", "lang = 'fr'", 0.12),
    ("main_site", "source = 'src0'", 0.12),
    ("small_sites", "source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9')", 0.10),
    ("long_form", "n_chars >= 4000", 0.14),
]
#: Tokens to select, as a share of all tokens.
BUDGET = 0.8
MAX_COPIES = 4
SEED = 5
LEVEL_BITS = 12


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    counts = [np.diff(lexical.words(texts[a:b]).first) for a, b in lexical.chunks(texts)]
    return pa.array(np.concatenate(counts) if counts else [], pa.int64())


class Network:
    """Successive cheapest augmenting paths; capacities are integers."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            cost: dict[int, int] = {source: 0}
            via: dict[int, int] = {}
            queue, queued = [source], {source}
            for a in queue:
                queued.discard(a)
                for e in self.out[a]:
                    b, capacity, price = self.arcs[e]
                    if capacity > 0 and (b not in cost or cost[a] + price < cost[b]):
                        cost[b], via[b] = cost[a] + price, e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if sink not in via:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.arcs[via[at] ^ 1][0]
            most = min(self.arcs[e][1] for e in path)
            for e in path:
                self.arcs[e][1] -= most
                self.arcs[e ^ 1][1] += most


def route(supply: dict[int, int], quotas: list[int], max_copies: int) -> dict[int, list[int]]:
    """For each pattern (a bit for each source it belongs to) the tokens that count for each source."""
    patterns = sorted(supply)
    n = len(patterns)
    net = Network(n + len(quotas) + 2)
    source, sink = n + len(quotas), n + len(quotas) + 1
    links = {}
    for i, p in enumerate(patterns):
        for k in range(max_copies):
            net.add(source, i, supply[p], k)
        for c in range(len(quotas)):
            if p >> c & 1:
                links[p, c] = net.add(i, n + c, supply[p] * max_copies, 0)
    for c, q in enumerate(quotas):
        net.add(n + c, sink, q, 0)
    net.run(source, sink)
    return {p: [net.arcs[links[p, c] ^ 1][1] if (p, c) in links else 0 for c in range(len(quotas))] for p in patterns}


@dataclass
class Segment:
    """Documents of a pattern whose hash range index is from low to high - 1 get a copy that counts for a source."""

    pattern: int
    copy: int
    low: int
    high: int
    source: int


def boundaries(total: int, flows: list[int], max_copies: int) -> list[tuple[int, int, int, int]]:
    """(copy, begin, end, source) along the pattern's tokens, for each copy."""
    out, at = [], 0
    for c, flow in enumerate(flows):
        begin, end = at, at + flow
        for k in range(max_copies):
            a, b = max(begin, k * total), min(end, (k + 1) * total)
            if a < b:
                out.append((k, a - k * total, b - k * total, c))
        at = end
    return out


def nearest(edges: list[int], sums: list[int], target: int) -> int:
    """The edge at which the running sum is nearest to the target, the lower at a tie."""
    return min(zip(edges, sums, strict=True), key=lambda x: (abs(x[1] - target), x[0]))[0]


def plan_mix(marked: DataFrame, weights: list[float], budget: float, max_copies: int) -> list[Segment]:
    """What to select. marked: pattern, place (0 <= place < 2**24) and n_tokens of every document."""
    size = 1 << LEVEL_BITS
    useful = marked.where("pattern > 0 and n_tokens > 0")
    coarse: dict[int, dict[int, int]] = {}
    # Patterns times 2**12 rows at most, whatever the number of documents.
    for r in useful.groupBy("pattern", F.shiftright("place", LEVEL_BITS).alias("range")).agg(F.sum("n_tokens").alias("n")).collect():
        coarse.setdefault(r.pattern, {})[r.range] = r.n
    total = marked.agg(F.sum("n_tokens")).first()[0] or 0
    supply = {p: sum(h.values()) for p, h in coarse.items()}
    flows = route(supply, [int(round(budget * total * w)) for w in weights], max_copies)
    cuts: list[tuple[int, int]] = []
    for p, f in flows.items():
        for _, a, b, _ in boundaries(supply[p], f, max_copies):
            cuts += [(p, a), (p, b)]

    def running(histogram: dict[int, int], base: int, start: int, step: int) -> tuple[list[int], list[int]]:
        edges, sums = [start], [base]
        for r in range(size):
            base += histogram.get(r, 0)
            edges.append(start + (r + 1) * step)
            sums.append(base)
        return edges, sums

    tables = {p: running(h, 0, 0, size) for p, h in coarse.items()}
    split: dict[tuple[int, int], list[int]] = {}
    for p, t in set(cuts):
        edges, sums = tables[p]
        inside = next((r for r in range(size) if sums[r] < t < sums[r + 1]), None)
        if inside is not None:
            split.setdefault((p, inside), []).append(t)
    fine: dict[tuple[int, int], dict[int, int]] = {}
    if split:
        wanted = marked.sparkSession.createDataFrame([(p, r) for p, r in split], "pattern bigint, range bigint")
        within = useful.withColumn("range", F.shiftright("place", LEVEL_BITS)).join(F.broadcast(wanted), ["pattern", "range"])
        for r in within.groupBy("pattern", "range", (F.col("place") % size).alias("sub")).agg(F.sum("n_tokens").alias("n")).collect():
            fine.setdefault((r.pattern, r.range), {})[r.sub] = r.n
    at: dict[tuple[int, int], int] = {}
    for p, t in set(cuts):
        edges, sums = tables[p]
        at[p, t] = nearest(edges, sums, t)
    for (p, r), targets in split.items():
        edges, sums = running(fine[p, r], tables[p][1][r], r * size, 1)
        for t in targets:
            at[p, t] = nearest(edges, sums, t)
    return [Segment(p, k, at[p, a], at[p, b], c) for p, f in flows.items() for k, a, b, c in boundaries(supply[p], f, max_copies) if at[p, a] < at[p, b]]


def marks(docs: DataFrame, sources: list[tuple[str, str, float]], seed: int, id_col: str, text_col: str) -> DataFrame:
    """docs under positional names, with pattern and place in front."""
    if len(sources) > 62:
        raise ValueError("62 sources at most")
    bits = [F.when(F.coalesce(F.expr(predicate).cast("boolean"), F.lit(False)), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, (_, predicate, _) in enumerate(sources)]
    pattern = F.lit(0).cast("bigint")
    for b in bits:
        pattern = pattern + b
    # Predicates see the columns by name (the first of those that differ by case only); what is kept has positional names.
    kept = [f"in_{i}" for i in range(len(docs.columns))]
    first: dict[str, int] = {}
    for i, name in enumerate(docs.columns):
        first.setdefault(name.lower(), i)
    inside = "kept"
    while inside in first:
        inside += "_"
    inner = positional(docs)
    hashed = F.xxhash64(F.lit(seed), place(docs, id_col), place(docs, text_col))
    named = inner.select(F.struct(hashed.alias("hash"), *kept).alias(inside), *[F.col(f"in_{i}").alias(docs.columns[i]) for i in first.values()])
    within = lambda c: F.col(f"{inside}.{c}")
    return named.select(pattern.alias("pattern"), within("hash").bitwiseAND((1 << 2 * LEVEL_BITS) - 1).alias("place"), *[within(c).alias(c) for c in kept])


def _selected(docs: DataFrame, sources, budget, max_copies, seed, id_col, text_col) -> tuple[DataFrame, DataFrame]:
    marked = marks(docs, sources, seed, id_col, text_col)
    narrow = settled(marked.select("pattern", "place", F.col(place(docs, id_col)).alias("doc_id"), word_count(place(docs, text_col)).alias("n_tokens")))
    plan = plan_mix(narrow, [w for _, _, w in sources], budget, max_copies)
    rows = [(s.pattern, s.copy, s.low, s.high, sources[s.source][0]) for s in plan]
    # A few rows for each pattern.
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "for_pattern bigint, copy int, low bigint, high bigint, mix_source string"))
    return narrow, table


def _within(df: DataFrame, table: DataFrame) -> DataFrame:
    return df.join(table, (F.col("pattern") == F.col("for_pattern")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))


def mix(docs: DataFrame, sources: list[tuple[str, str, float]] = SOURCES, budget: float = BUDGET, max_copies: int = MAX_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each copy of each selected document: doc_id, copy (from 0), mix_source (what it counts for) and n_tokens."""
    narrow, table = _selected(docs, sources, budget, max_copies, seed, id_col, text_col)
    return _within(narrow.where("n_tokens > 0"), table).select("doc_id", "copy", "mix_source", "n_tokens")


def mixed_documents(docs: DataFrame, sources: list[tuple[str, str, float]] = SOURCES, budget: float = BUDGET, max_copies: int = MAX_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected rows of docs, with their columns, once for each copy."""
    _, table = _selected(docs, sources, budget, max_copies, seed, id_col, text_col)
    marked = marks(docs, sources, seed, id_col, text_col)
    chosen = _within(marked, table).where(word_count(place(docs, text_col)) > 0)
    return chosen.select(*[f"in_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
