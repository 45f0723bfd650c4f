"""A small language for graphs in URLs: edges with ~ between them, each 'source_target_value' with _ between the
fields, and each node 'name,charge,group'. Charge is 1.0, group 0 and value 4 where they aren't given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE, FIELD, NODE = "~", "_", ","


def node(text: Column) -> Column:
    """(name, charge, node_group) of a node's text."""
    part = lambda i: F.try_element_at(F.split(text, NODE), F.lit(i))
    return F.struct(F.coalesce(part(1), F.lit("")).alias("name"), F.coalesce(part(2).try_cast("double"), F.lit(1.0)).alias("charge"), F.coalesce(part(3).try_cast("int"), F.lit(0)).alias("node_group"))


def _edges(table: DataFrame, key: str, text: str) -> DataFrame:
    parts = table.select(F.col(key).alias("graph"), F.posexplode(F.split(F.col(text), EDGE)).alias("position", "edge")).withColumn("f", F.split("edge", FIELD))
    get = lambda i: F.try_element_at("f", F.lit(i))
    return parts.select("graph", "position", node(F.coalesce(get(1), F.lit(""))).alias("s"), node(F.coalesce(get(2), F.lit(""))).alias("t"), F.coalesce(get(3).try_cast("double"), F.lit(4.0)).alias("value"))


def nodes(table: DataFrame, key: str, text: str) -> DataFrame:
    """graph, index (from 0, in order of first mention), name, charge and node_group (as first mentioned)."""
    from pyspark.sql import Window

    e = _edges(table, key, text)
    seen = e.select("graph", F.explode(F.array(F.struct((F.col("position") * 2).alias("at"), F.col("s").alias("n")), F.struct((F.col("position") * 2 + 1).alias("at"), F.col("t").alias("n")))).alias("x")).select("graph", "x.at", "x.n.*").where("name <> ''")
    first = seen.groupBy("graph", "name").agg(F.min(F.struct("at", "charge", "node_group")).alias("f"))
    return first.select("graph", (F.row_number().over(Window.partitionBy("graph").orderBy("f.at")) - 1).alias("index"), "name", "f.charge", "f.node_group")


def edges(table: DataFrame, key: str, text: str) -> DataFrame:
    """graph, position, source and target (indices of nodes) and value."""
    e, n = _edges(table, key, text), nodes(table, key, text)
    s = n.select("graph", F.col("name").alias("source_name"), F.col("index").alias("source"))
    t = n.select("graph", F.col("name").alias("target_name"), F.col("index").alias("target"))
    named = e.select("graph", "position", F.col("s.name").alias("source_name"), F.col("t.name").alias("target_name"), "value")
    return named.join(s, ["graph", "source_name"]).join(t, ["graph", "target_name"]).select("graph", "position", "source", "target", "value")
