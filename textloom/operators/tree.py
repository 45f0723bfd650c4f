"""A decision tree by exhaustive split search: every value of every feature, scored in one query for each level.

Numbers split by >=, other values by equality. Nodes are a dict of plain
values, few enough for the driver; rows never leave the cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


@dataclass
class Node:
    """A split (column, value, branches) or a leaf (results: counts by label)."""

    column: str | None = None
    value: object = None
    numeric: bool = False
    results: dict[str, int] = field(default_factory=dict)
    yes: Node | None = None
    no: Node | None = None


def impurity(counts: Column | dict, kind: str = "entropy"):
    """entropy (base 2) or gini of a dict of counts."""
    total = sum(counts.values())
    if not total:
        return 0.0
    p = [c / total for c in counts.values() if c]
    return 1 - sum(x * x for x in p) if kind == "gini" else -sum(x * math.log2(x) for x in p)


def _score(n_ln: Column, squares: Column, total: Column, kind: str) -> Column:
    if kind == "gini":
        return F.when(total > 0, 1 - squares / (total * total)).otherwise(0.0)
    return F.when(total > 0, (F.ln(total) - n_ln / total) / math.log(2)).otherwise(0.0)


def split_scores(table: DataFrame, label: str, features: list[str], node: str | None = None, kind: str = "entropy") -> DataFrame:
    """node (0 if there is no such column), feature, numeric, value (text), number, n, n_yes and gain of every split.

    For numbers, running counts by label over the distinct values from the highest down; for others, counts of each value."""
    kinds = dict(table.dtypes)
    key = F.col(node) if node else F.lit(0)
    cells = table.select(
        key.alias("node"),
        F.col(label).cast("string").alias("label"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(kinds[f] in NUMERIC).alias("numeric"), F.col(f).cast("string").alias("value"), (F.col(f).cast("double") if kinds[f] in NUMERIC else F.lit(None).cast("double")).alias("number")) for f in features])).alias("c"),
    ).select("node", "label", "c.*").where("value is not null and label is not null")
    counts = cells.groupBy("node", "feature", "numeric", "value", "number", "label").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("node", "feature", "label").agg(F.sum("c").alias("t"))
    values = counts.select("node", "feature", "numeric", "value", "number").distinct()
    grid = values.join(totals, ["node", "feature"]).join(counts, ["node", "feature", "numeric", "value", "label"], "left").select("node", "feature", "numeric", "value", values["number"], "label", "t", F.coalesce("c", F.lit(0)).alias("c"))
    run = Window.partitionBy("node", "feature", "label").orderBy(F.desc("number"))
    yes = F.when(F.col("numeric"), F.sum("c").over(run)).otherwise(F.col("c"))
    own = grid.select("node", "feature", "numeric", "value", "number", "label", F.col("t").cast("double").alias("t"), yes.cast("double").alias("y")).withColumn("z", F.col("t") - F.col("y"))
    xlnx = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c))).otherwise(0.0)
    s = own.groupBy("node", "feature", "numeric", "value", "number").agg(*[a for c in "tyz" for a in (F.sum(c).alias(c), F.sum(xlnx(c)).alias(f"{c}_ln"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_sq"))])
    score = lambda c: _score(F.col(f"{c}_ln"), F.col(f"{c}_sq"), F.col(c), kind)
    p = F.col("y") / F.col("t")
    return s.where("y > 0 and z > 0").select("node", "feature", "numeric", "value", "number", F.col("t").cast("bigint").alias("n"), F.col("y").cast("bigint").alias("n_yes"), (score("t") - p * score("y") - (1 - p) * score("z")).alias("gain"))


def best_splits(table: DataFrame, label: str, features: list[str], node: str | None = None, kind: str = "entropy") -> DataFrame:
    """The split of most gain (9 places) for each node; of equals the first feature by name, then the lowest value."""
    s = split_scores(table, label, features, node, kind).withColumn("gain", F.round("gain", 9))
    order = Window.partitionBy("node").orderBy(F.desc("gain"), "feature", "number", "value")
    return s.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def test(node: Node) -> Column:
    """Whether a row goes to the node's yes branch; false for null."""
    c = F.col(node.column)
    return F.coalesce(c >= node.value if node.numeric else c.cast("string") == node.value, F.lit(False))


def build(table: DataFrame, label: str, features: list[str], kind: str = "entropy", depth: int = 20, least_gain: float = 1e-9) -> Node:
    """Grow level by level as long as splits gain. One query a level scores all of its nodes; rows with their nodes are
    checkpointed at each level, so none is worked out again."""
    from ..sources.folders import settled

    root = Node(results={r[0]: r[1] for r in table.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().collect()})
    open_nodes = {0: root}
    state = table.where(F.col(label).isNotNull()).select(label, *features, F.lit(0).alias("__node"))
    for _ in range(depth):
        state = state.where(F.col("__node").isin(*open_nodes))
        found = {r.node: r for r in best_splits(state, label, features, "__node", kind).where(F.col("gain") > least_gain).collect()}
        if not found:
            break
        where, nodes = F.lit(-1), {}
        for i, r in found.items():
            n = open_nodes[i]
            n.column, n.numeric, n.value = r.feature, r.numeric, r.number if r.numeric else r.value
            n.yes, n.no = Node(), Node()
            nodes[2 * i + 1], nodes[2 * i + 2] = n.yes, n.no
            where = F.when(F.col("__node") == i, F.when(test(n), 2 * i + 1).otherwise(2 * i + 2)).otherwise(where)
        state = settled(state.withColumn("__node", where))
        for r in state.where("__node > 0").groupBy("__node", F.col(label).cast("string").alias("l")).count().collect():
            nodes[r[0]].results[r[1]] = r[2]
        open_nodes = {i: n for i, n in nodes.items() if len(n.results) > 1}
        if not open_nodes:
            break
    return root


def majority(results: dict[str, int]) -> str | None:
    return min(results, key=lambda k: (-results[k], k)) if results else None


def classified(node: Node) -> Column:
    """The tree as an expression: the label that most rows of the leaf have."""
    if node.yes is None:
        return F.lit(majority(node.results))
    return F.when(test(node), classified(node.yes)).otherwise(classified(node.no))


def classify(row: dict, node: Node) -> dict[str, float]:
    """Counts of a row's leaf; where its value is missing, both branches weighed by their rows."""
    if node.yes is None:
        return {k: float(v) for k, v in node.results.items()}
    value = row.get(node.column)
    if value is not None:
        return classify(row, node.yes if (value >= node.value if node.numeric else str(value) == node.value) else node.no)
    yes, no = classify(row, node.yes), classify(row, node.no)
    a, b = sum(yes.values()), sum(no.values())
    return {k: yes.get(k, 0) * a / (a + b) + no.get(k, 0) * b / (a + b) for k in sorted({*yes, *no})}


def prune(node: Node, least_gain: float) -> Node:
    """Leaves that gained less than least_gain over their parent are joined to it, from the bottom up."""
    if node.yes is None:
        return node
    yes, no = prune(node.yes, least_gain), prune(node.no, least_gain)
    if yes.yes is None and no.yes is None:
        a, b = sum(yes.results.values()), sum(no.results.values())
        both = {k: yes.results.get(k, 0) + no.results.get(k, 0) for k in {*yes.results, *no.results}}
        gain = impurity(both) - (a * impurity(yes.results) + b * impurity(no.results)) / max(a + b, 1)
        if gain < least_gain:
            return Node(results=both)
    return Node(node.column, node.value, node.numeric, node.results, yes, no)


def text(node: Node, indent: str = "") -> str:
    if node.yes is None:
        return str(dict(sorted(node.results.items())))
    sign = ">=" if node.numeric else "=="
    return f"{node.column} {sign} {node.value}?\n{indent}T-> {text(node.yes, indent + '  ')}\n{indent}F-> {text(node.no, indent + '  ')}"


def width(node: Node) -> int:
    return 1 if node.yes is None else width(node.yes) + width(node.no)


def depth(node: Node) -> int:
    return 0 if node.yes is None else 1 + max(depth(node.yes), depth(node.no))
