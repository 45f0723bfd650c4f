"""Near duplicates: SimHash fingerprints joined through vantage-point trees.

A document's features are its distinct words, weighted by inverse document
frequency over all documents. Its fingerprint has 256 bits: the signs of the
weighted sums of the words' seeded +-1 vectors. Two documents are near
duplicates if their fingerprints differ in at most RADIUS bits; how long they
are doesn't matter, so copies that were cut short or extended are found as far
as RADIUS allows.

Every such pair is found. Fingerprints are cut into groups by hash, and every
pair of groups is a cell of its own, so no task depends on the number of
documents. A cell reads its groups from the shared folder. In a large cell
the bits are cut into blocks with thresholds: fingerprints within RADIUS are
within the threshold of some block, so for each block only buckets of codes that
differ in at most its threshold are compared, at first in the block and those
after it (see chain), and a pair counts for the first such block only. What is compared goes through a vantage-point tree, which splits both sides at the median
distance (of all bits) from a vantage point; by the triangle inequality only
points within the radius of the boundary can have partners beyond it, and just
these are compared across it. A node is split only where that saves work.

Groups are the connected components of the pairs; a cell gives the edges of a
spanning forest instead of all its pairs, so a group of many copies stays
linear. The lowest doc_id of a group stays. How many others a fingerprint is
near to is counted over all cells.

Cases: texts that are null or have no words are never duplicates. Very long
texts count whole, by their distinct words. Fingerprints of equal distance all
count, so ties don't occur. Extra columns, whatever their names, play no part;
keep_documents returns them as they are. Rows with a
null doc_id can't be named in a result: they have no duplicates, and all stay.
Rows that share a doc_id count as one document: texts with one id are in one
group, and one of the rows stays (the one with the least text). Documents with
equal word sets have equal fingerprints. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexical
from .frames import broadcast_checked, narrow, new_folder, per_batch, place, positional, settled, stored_row, summed_arrays

BITS, BUCKETS, SEED = 256, 1 << 16, 11
RADIUS = 64
#: Fingerprints of one side of a cell at most.
GROUP = 1 << 20
#: Fingerprints a bucket, and the fewest bits of a code; with fewer fingerprints a cell has no buckets.
BUCKET, LEAST_BITS = 24, 12
#: Pairs of a unit of work of a cell.
UNIT_PAIRS = 1 << 29


def feature_buckets(texts: lexical.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each text, and the text of each."""
    w = lexical.words(texts)
    b = (w.hashes() % np.uint64(buckets)).astype(np.int64)
    own = np.unique(w.doc * buckets + b)
    return own % buckets, own // buckets


def document_frequencies(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """In how many texts each bucket occurs; at the end, the number of texts."""

    def make():
        def step(columns):
            rows = columns[0]
            for a, b in lexical.chunks(rows):
                step.total[:-1] += np.bincount(feature_buckets(rows[a:b], buckets)[0], minlength=buckets)
            step.total[-1] += len(rows)

        step.total = np.zeros(buckets + 1, np.int64)
        return step

    return summed_arrays(texts, make, buckets + 1)


def bucket_weights(frequencies: np.ndarray) -> np.ndarray:
    """1 to 127, in proportion to the inverse document frequency."""
    n, df = frequencies[-1], frequencies[:-1]
    idf = np.log((n + 1) / (df + 0.5)).clip(0)
    return np.maximum(1, np.round(127 * idf / max(idf.max(), 1e-9))).astype(np.int8)


def sign_table(weights: np.ndarray, seed: int = SEED) -> np.ndarray:
    """For each bucket its weight with the signs of its bits."""
    raw = np.random.default_rng(seed).integers(0, 256, (len(weights), BITS // 8), np.uint8)
    return (np.unpackbits(raw, axis=1).astype(np.int16) * 2 - 1) * weights[:, None]


def fingerprints_of(texts: lexical.Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of 4 words) and numbers of features; without features all is 0."""
    out, sizes = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), np.int64)
    for a, b in lexical.chunks(texts, lexical.CHUNK_CHARS // 2):
        bucket, doc = feature_buckets(texts[a:b], len(table))
        sizes[a:b] = n = np.bincount(doc, minlength=b - a)
        end = np.cumsum(n)
        for i in np.flatnonzero(n):
            sums = table.take(bucket[end[i] - n[i] : end[i]], 0).sum(0, dtype=np.int32)
            out[a + i] = np.packbits(sums > 0).view(np.uint64)
    return out, sizes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (32 bytes) of all rows that have a doc_id and words."""
    own = narrow(docs, doc_id=id_col, text=text_col)
    weights = bucket_weights(document_frequencies(own.select("text")))

    def make():
        table = sign_table(weights)

        def step(columns):
            texts = columns[1]
            fp, sizes = fingerprints_of(texts, table)
            has = np.flatnonzero((sizes > 0) & columns[0].is_valid().to_numpy(zero_copy_only=False))
            yield {"doc_id": columns[0].take(pa.array(has)), "fp": [r.tobytes() for r in fp[has]]}

        return step

    return per_batch(own, make, "doc_id bigint, fp binary")


class Near:
    """Which rows of a and b (fingerprints, a word a column) differ in at most radius bits, in blocks."""

    ROWS, COLUMNS = 32, 1024

    def __init__(self, a: np.ndarray, b: np.ndarray, radius: int):
        self.a, self.b, self.radius = [np.ascontiguousarray(c) for c in a.T], [np.ascontiguousarray(c) for c in b.T], radius
        self.both = np.empty(self.ROWS * self.COLUMNS, np.uint64)

    def pairs(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Of rows i, i + 1, ... of a and j, j + 1, ... of b, at most a block."""
        x, y = [c[i : i + self.ROWS, None] for c in self.a], [c[j : j + self.COLUMNS] for c in self.b]
        both = self.both[: len(x[0]) * len(y[0])].reshape(len(x[0]), -1)
        d = None
        for p, q in zip(x[: max(1, len(x) - 1)], y, strict=False):  # 192 bits fit a byte
            np.bitwise_xor(p, q, out=both)
            d = np.bitwise_count(both) if d is None else np.add(d, np.bitwise_count(both), out=d)
        # The minimum costs far less than the places, and mostly there are none.
        at = np.flatnonzero(d <= self.radius) if d.min() <= self.radius else np.zeros(0, np.int64)
        u, v = at // len(y[0]), at % len(y[0])
        if len(at) and len(x) > 1:  # what is left of the bits decides for these few
            near = d.ravel()[at] + np.bitwise_count(x[-1][u, 0] ^ y[-1][v]).astype(np.int64) <= self.radius
            u, v = u[near], v[near]
        return u + i, v + j


def vantage_pairs(fp: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, least: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places (i from left, j from right; each pair of left once if right is None) whose
    fingerprints (rows of words, or single words) differ in at most radius bits, by a vantage-point
    tree with exact triangle bounds."""
    own = right is None
    other = left if own else right
    if not len(left) or not len(other):
        return
    fp = fp.reshape(len(fp), -1)
    if len(left) * len(other) > least:
        v = fp[left[len(left) // 2]]
        dl = np.bitwise_count(fp[left] ^ v).sum(1, dtype=np.int16)
        dr = dl if own else np.bitwise_count(fp[other] ^ v).sum(1, dtype=np.int16)
        middle = int(np.median(dl))
        ln, lf, rn, rf = left[dl <= middle], left[dl > middle], other[dr <= middle], other[dr > middle]
        # Partners beyond the boundary are within the radius of it, and so is the point itself.
        cross = [(left[(dl <= middle) & (dl > middle - radius)], other[(dr > middle) & (dr <= middle + radius)])]
        if not own:
            cross.append((left[(dl > middle) & (dl <= middle + radius)], other[(dr <= middle) & (dr > middle - radius)]))
        work = len(ln) * len(rn) + len(lf) * len(rf) + (1 + own) * sum(len(a) * len(b) for a, b in cross)
        if work < 0.85 * len(left) * len(other):
            yield from vantage_pairs(fp, ln, None if own else rn, radius, least)
            yield from vantage_pairs(fp, lf, None if own else rf, radius, least)
            for a, b in cross:
                yield from vantage_pairs(fp, a, b, radius, least)
            return
    near = Near(fp[left], fp[other], radius)
    for a in range(0, len(left), near.ROWS):
        for b in range(a // near.COLUMNS * near.COLUMNS if own else 0, len(other), near.COLUMNS):
            i, j = near.pairs(a, b)
            if own:
                ahead = j > i
                i, j = i[ahead], j[ahead]
            if len(i):
                yield left[i], other[j]


def bit_blocks(n: int, radius: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """First bit, width and threshold of blocks: fingerprints that differ in at most radius bits differ
    in at most the threshold of some block. None where n fingerprints are too few for buckets by a block's bits.

    If all blocks differed in more than their thresholds, it would be in the sum of (threshold + 1) = radius + 1 bits.
    chain makes more of that."""
    width = int(np.log2(max(1, n / BUCKET)))
    if width < LEAST_BITS:
        return []
    many = bits // width
    cuts = [bits * k // many for k in range(many + 1)]
    widths = np.diff(cuts)
    more = np.argsort(-widths, kind="stable")[: (radius + 1) % many]  # the widest blocks get the higher threshold
    t = np.full(many, (radius + 1) // many - 1)
    t[more] += 1
    return list(zip(cuts[:-1], widths.tolist(), t.tolist(), strict=True))


def codes(fp: np.ndarray, first: int, width: int) -> np.ndarray:
    """At most 64 bits of every fingerprint (rows of words) from the first on, around the end."""
    word, at = divmod(first, 64)
    own = fp[:, word] >> np.uint64(at)
    if at + width > 64:
        own = own | (fp[:, (word + 1) % fp.shape[1]] << np.uint64(64 - at))
    return own & np.uint64((1 << width) - 1)


def chain(blocks: list[tuple[int, int, int]], block: int) -> tuple[int, int, int]:
    """First bit, width and threshold of a block and as many that follow it in a ring as fit a word.

    The sums of (difference - threshold - 1) over all blocks are negative, so from some block on, around the ring,
    all of their partial sums are: of that block and of its chain alike."""
    many = min(len(blocks), 64 // max(w for _, w, _ in blocks))
    own = [blocks[(block + k) % len(blocks)] for k in range(many)]
    return own[0][0], sum(w for _, w, _ in own), sum(t + 1 for *_, t in own) - 1


def bucket_pairs(fp: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, block: int, blocks: list[tuple[int, int, int]], part: int = 0, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of vantage_pairs for which this is the first of the blocks that is within its threshold with its chain.

    Only buckets whose codes are within it are compared, by vantage-point trees over the chain's bits; all bits
    decide for what is found. Of left's buckets, one of parts."""
    first, width, most = blocks[block]
    if most < 0:
        return
    masks = np.arange(1 << width)
    masks = masks[np.bitwise_count(masks) <= most]

    def sorted_by(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = codes(fp[places], first, width).astype(np.int64)
        by = np.argsort(code, kind="stable")
        return places[by], np.searchsorted(code[by], np.arange((1 << width) + 1))

    own = right is None
    left, begin = sorted_by(left)
    other, start = (left, begin) if own else sorted_by(right)
    places = left if own else np.concatenate([left, other])
    fp, shift = fp[places], 0 if own else len(left)  # buckets lie together
    at, bits, bound = chain(blocks, block)
    if bound < 0:
        return
    words, held, many = codes(fp, at, bits), [], 0

    def decided() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        d = fp[i] ^ fp[j]
        near = np.bitwise_count(d).sum(1, dtype=np.int64) <= radius
        i, j, d = i[near], j[near], d[near]
        before = np.zeros(len(i), bool)
        for k in range(block):
            within = [np.bitwise_count(codes(d, a, w)) <= t for a, w, t in (blocks[k], chain(blocks, k))]
            before |= within[0] & within[1]
        return places[i[~before]], places[j[~before]]

    for u in range(part, 1 << width, parts):
        here = np.arange(begin[u], begin[u + 1])
        if not len(here):
            continue
        v = u ^ masks
        if own:
            v = v[v > u]
        there = lexical.ragged(start[v] + shift, start[v + 1] - start[v])
        for some in (vantage_pairs(words, here, None, bound) if own else (), vantage_pairs(words, here, there, bound)):
            for i, j in some:
                held.append((i, j))
                many += len(i)
                if many > 100_000:
                    yield decided()
                    held, many = [], 0
    if held:
        yield decided()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest place in the component of each of n places, given edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, again := new[new]):
            new = again
        if np.array_equal(new, label):
            return label
        label = new


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a spanning forest of near pairs of n places, and in how many pairs each place is."""
    a, b, held = [], [], 0
    links = np.zeros(n, np.int64)

    def reduced():
        if not a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r = roots(n, np.concatenate(a), np.concatenate(b))
        i = np.flatnonzero(r != np.arange(n))
        return i, r[i]

    for i, j in pairs:
        a.append(i)
        b.append(j)
        held += len(i)
        np.add.at(links, i, 1)
        np.add.at(links, j, 1)
        if held > 2_000_000:
            x, y = reduced()
            a, b, held = [x], [y], 0
    return *reduced(), links


def stored_groups(fps: DataFrame, groups: int) -> str:
    """A folder with the fingerprints of each group by hash, which all executors read."""

    def make():
        def step(columns):
            n = len(columns[0])
            fp = np.frombuffer(b"".join(columns[1].to_pylist()), np.uint64).reshape(n, -1)
            yield {"part": (fp[:, -1] % np.uint64(groups)).astype(np.int64), "rep": columns[0], "fp": columns[1]}

        return step

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")  # the order of arrival doesn't matter
        rep = table["rep"].to_numpy().astype(np.int64)
        fp = b"".join(table["fp"].to_pylist())
        return pa.table({"part": table["part"].slice(0, 1).combine_chunks(), "rep": pa.array([rep.tobytes()], pa.binary()), "fp": pa.array([fp], pa.binary())})

    at = new_folder(fps.sparkSession, "fingerprints")
    parted = per_batch(fps.select("rep", "fp"), make, "part bigint, rep bigint, fp binary")
    parted.groupBy("part").applyInArrow(one, "part bigint, rep binary, fp binary").write.partitionBy("part").parquet(at)
    return at


def near_edges(fps: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Of fps (rep, fp; distinct fingerprints): rows u, v of edges that connect all near pairs, and
    rows u, links of how many near pairs of a unit of work u is in."""
    n = fps.count()
    groups = max(1, -(-n // group))
    at, size = stored_groups(fps, groups), n / groups
    stored_at = {r.part for r in fps.sparkSession.read.parquet(at).select("part").collect()} if n else set()
    blocks = bit_blocks(int(size), radius)
    parts = max(1, min(1024, int(size * size / (UNIT_PAIRS if not blocks else UNIT_PAIRS * 128))))
    a_cell = parts * max(1, len(blocks))
    cells = [(i, j) for i in sorted(stored_at) for j in sorted(stored_at) if i <= j]

    def make():
        held: dict = {}

        def loaded(k: int) -> tuple[np.ndarray, np.ndarray]:
            row = stored_row(at, "part", k)
            rep = np.frombuffer(row["rep"], np.int64)
            return rep, np.frombuffer(row["fp"], np.uint64).reshape(len(rep), -1)

        def step(columns):
            for unit in columns[0].to_pylist():
                cell, rest = divmod(unit, a_cell)
                i, j = cells[cell]
                if held.get("cell") != cell:
                    held.clear()
                    held.update(cell=cell, both=[loaded(k) for k in ((i,) if i == j else (i, j))])
                rep, fp = (np.concatenate(x) if i != j else x[0] for x in zip(*held["both"], strict=True))
                everything, edge = np.arange(len(rep)), len(held["both"][0][0])
                left, right = (everything, None) if i == j else (everything[:edge], everything[edge:])
                block, part = divmod(rest, parts)
                if blocks:
                    pairs = bucket_pairs(fp, left, right, radius, block, blocks, part, parts)
                else:
                    pairs = strip_pairs(fp, left, right, radius, part, parts)
                x, y, links = forest(len(rep), pairs)
                some = np.flatnonzero(links)
                own = np.repeat([False, True], [len(y), len(some)])
                yield {"u": np.concatenate([rep[x], rep[some]]), "v": pa.array(np.concatenate([rep[y], rep[some]]), mask=own), "links": np.concatenate([np.zeros(len(x), np.int64), links[some]])}

        return step

    many = len(cells) * a_cell
    units = fps.sparkSession.range(0, many, 1, max(1, min(many, 4096)))
    return per_batch(units, make, "u bigint, v bigint, links bigint")


def strip_pairs(fp: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of vantage_pairs of one of parts of left; all parts give each pair once."""
    if parts == 1:
        yield from vantage_pairs(fp, left, right, radius)
        return
    strip = left[part::parts]
    if right is None:
        yield from vantage_pairs(fp, strip, None, radius)
        for more in range(part + 1, parts):
            yield from vantage_pairs(fp, strip, left[more::parts], radius)
    else:
        yield from vantage_pairs(fp, strip, right, radius)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the lowest node of its component) of every node of edges (u, v).

    Every round a node takes the lowest label around it and then that label's label."""
    # Both directions of each edge from one evaluation: another one may give another forest of the same groups.
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = settled(edges.where("u <> v").select(ends.alias("e")).select("e.*").distinct())
    labels = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("low"))
        lower = labels.join(around, labels["node"] == around["u"]).select("node", F.col("root").alias("was"), F.least("root", "low").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("jump"))
        new = settled(lower.join(jump, lower["low"] == jump["at"], "left").select("node", "was", F.least("low", "jump").alias("root")))
        labels = new.select("node", "root")
        if new.where("was <> root").isEmpty():
            return labels


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id, duplicate_of (its class: the lowest doc_id of its group) and n_links (how many other fingerprints are
    near its own; of several texts the most) for every document that isn't the lowest of its group itself."""
    rows = settled(fingerprints(docs, id_col, text_col))
    distinct = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # Documents of several texts tie their fingerprints together.
    tied = rows.join(distinct.select("fp", "rep"), "fp").groupBy("doc_id").agg(F.min("rep").alias("v"), F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    ties = tied.select(F.explode("reps").alias("u"), "v")
    near = settled(near_edges(distinct, radius, group))
    roots_of = components(near.where("v is not null").select("u", "v").union(ties))
    links = near.groupBy(F.col("u").alias("linked")).agg(F.sum("links").alias("n_links"))
    of_text = rows.join(distinct.select("fp", "rep"), "fp").join(links, F.col("rep") == links["linked"], "left")
    own = of_text.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links"))
    found = own.join(roots_of, own["rep"] == roots_of["node"], "left").select("doc_id", F.coalesce("root", "rep").alias("duplicate_of"), "n_links")
    return found.where("doc_id <> duplicate_of")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their columns, without those that groups_of names; of rows that share a doc_id one."""
    names, key, text = docs.columns, place(docs, id_col), place(docs, text_col)
    inner = positional(docs)
    gone = groups_of(docs, id_col, text_col, **options).select(F.col("doc_id").alias("marked"), F.lit(False).alias("again"))
    repeated = inner.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("marked")).count().where("count > 1").select("marked", F.lit(True).alias("again"))
    marks = settled(gone.union(repeated).groupBy("marked").agg(F.min("again").alias("again")))
    both = inner.join(broadcast_checked(marks), inner[key] == marks["marked"], "left")
    once = both.where("marked is null").drop("marked", "again")
    some = both.where("again").drop("marked", "again")
    first = some.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(text).asc_nulls_last()))).where("place = 1").drop("place")
    return once.unionByName(first).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
