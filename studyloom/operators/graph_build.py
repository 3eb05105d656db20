"""A prerequisite graph built from data: edges from tags that occur together, cycles contracted, topological levels.

Cycles are found as strongly connected components by colouring: every node takes the greatest name that reaches it; nodes of a
colour from which the colour's own node can be reached are one component. Edges between colours can't be in a component and
are dropped, nodes without an edge in or out are components of their own, and the rest goes into the next round. Each
step is a join and an aggregation; tables of past steps are cleared. Steps grow with the longest path inside what is left, not with the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Documents that two tags share at least; of those with the tag so many of 100 have its prerequisite too.
SUPPORT, SHARE = 2, 50


def tag_edges(tags: DataFrame, support: int = SUPPORT, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, n), (edges: node, prerequisite, n_both) of tags (doc_id, tags), a short array.

    A tag's prerequisites are tags at least as frequent that most of its documents have as well. Tags that always come together are each
    other's prerequisites. The pairs of a document grow with the square of its tags, of which the data model has a few.
    """
    rows = tags.select("doc_id", F.array_distinct(F.filter("tags", lambda t: t.isNotNull())).alias("tags"))
    nodes = rows.select(F.explode("tags").alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    pairs = rows.select(F.explode("tags").alias("node"), "tags").select("node", F.explode("tags").alias("prerequisite")).where("node <> prerequisite")
    both = pairs.groupBy("node", "prerequisite").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    of = nodes.select(F.col("node").alias("prerequisite"), F.col("n").alias("n_of"))
    edges = both.join(nodes, "node").join(of, "prerequisite").where(f"n_of >= n AND 100 * n_both >= {share} * n")
    return nodes, edges.select("node", "prerequisite", "n_both")


def _spread(values: DataFrame, edges: DataFrame, pick: str) -> DataFrame:
    """(node, value): values (node, value) carried along edges (a, b) until nothing changes; pick (max) tells which of several stays."""
    while True:
        came = edges.join(values.select(F.col("node").alias("a"), "value"), "a").select(F.col("b").alias("node"), "value")
        new = values.unionByName(came).groupBy("node").agg(F.expr(f"{pick}(value)").alias("value"))
        new = written(new.join(values.withColumnRenamed("value", "was"), "node", "left"))
        dropped(edges.sparkSession, values)
        values = new.select("node", "value")
        if new.where("NOT value <=> was").isEmpty():
            return values


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node of those that reach each other along edges (a, b)."""
    spark, parts = nodes.sparkSession, []
    open_ = written(edges.select("a", "b").where("a <> b").distinct())
    while not open_.isEmpty():
        # nodes without an edge in or out are on no cycle
        inner = open_.select(F.col("a").alias("node")).intersect(open_.select(F.col("b").alias("node")))
        kept = written(open_.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").join(inner.withColumnRenamed("node", "b"), "b", "left_semi"))
        dropped(spark, open_)
        if kept.isEmpty():
            open_ = kept
            break
        names = kept.select(F.col("a").alias("node")).union(kept.select("b")).distinct()
        colour = _spread(written(names.withColumn("value", F.col("node"))), kept, "max")
        ca, cb = (colour.select(F.col("node").alias(x), F.col("value").alias(f"c{x}")) for x in "ab")
        same = written(kept.join(ca, "a").join(cb, "b").where("ca = cb").select("a", "b", "ca"))
        back = same.select(F.col("b").alias("a"), F.col("a").alias("b"))
        found = _spread(written(colour.where("node = value")), back, "max")
        part = written(found.groupBy("value").agg(F.min("node").alias("component")).join(found, "value").select("node", "component"))
        parts.append(part)
        gone = part.select("node")
        left = same.select("a", "b").join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        open_ = written(left)
        dropped(spark, kept, same, colour, found)
    out = nodes.select("node")
    whole = None
    for p in parts:
        whole = p if whole is None else whole.unionByName(p)
    if whole is None:
        return out.withColumn("component", F.col("node"))
    return out.join(whole, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def levels(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, level) from (node, component) and edges (node, prerequisite): 0 without prerequisites outside the own component, else one more than the highest of theirs."""
    own, other = (components.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("node", "b"), ("prerequisite", "a")))
    between = written(edges.join(own, "node").join(other, "prerequisite").where("a <> b").select("a", "b").distinct())
    level = written(components.select(F.col("component").alias("node")).distinct().withColumn("value", F.lit(0)))
    while True:
        came = between.join(level.select(F.col("node").alias("a"), "value"), "a").select(F.col("b").alias("node"), (F.col("value") + 1).alias("value"))
        new = written(level.unionByName(came).groupBy("node").agg(F.max("value").alias("value")).join(level.withColumnRenamed("value", "was"), "node"))
        dropped(components.sparkSession, level)
        level = new.select("node", "value")
        if new.where("value <> was").isEmpty():
            break
    return components.join(level.select(F.col("node").alias("component"), F.col("value").alias("level")), "component").select("node", "component", "level")


def build(tags: DataFrame, support: int = SUPPORT, share: int = SHARE) -> DataFrame:
    """node, n, component, level, prerequisites (sorted) of the tags of documents. Null tags are none."""
    nodes, edges = tag_edges(tags, support, share)
    nodes, edges = written(nodes), written(edges)
    # from a prerequisite to what needs it
    parts = written(strong_components(nodes, edges.select(F.col("prerequisite").alias("a"), F.col("node").alias("b"))))
    needs = edges.groupBy("node").agg(F.sort_array(F.collect_list("prerequisite")).alias("prerequisites"))
    none = F.expr("cast(array() as array<string>)")
    return nodes.join(levels(parts, edges), "node").join(needs, "node", "left").withColumn("prerequisites", F.coalesce("prerequisites", none))
