"""Prerequisite tracing over the topic graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def edges_of(nodes: DataFrame) -> DataFrame:
    """(node_id, at, prerequisite) from nodes (node_id, prerequisites)."""
    return nodes.select("node_id", F.posexplode("prerequisites").alias("at", "prerequisite"))


def trace(roots: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(query_id, node_id, depth, path): prerequisites within depth hops of roots (query_id, root_at, node_id[, max_depth]).

    Breadth first: a node's key is its least depth, there the least path (root number, then places in the lists), and results
    are read in order of (depth, path). A root is a result only if an earlier root lists it. Unknown nodes are results without
    prerequisites. Each hop is one equi-join; cycles end as found nodes aren't expanded again. Roots and hops are tables, so that the
    next hop's plan holds a scan of them and not, several times over, the plan and broadcast tables of all hops before.
    """
    limit = F.col("max_depth") if "max_depth" in roots.columns else F.lit(depth)
    roots = roots.select("query_id", "root_at", "node_id", limit.alias("max_depth"))
    # of a root given twice the first counts
    roots = written(roots.groupBy("query_id", "node_id").agg(F.min("root_at").alias("root_at"), F.first("max_depth").alias("max_depth")))
    own = roots.select(F.col("query_id").alias("own_query"), F.col("node_id").alias("root"), F.col("root_at").alias("own_at"))
    front = roots.select("query_id", "node_id", F.array("root_at").alias("path"), "max_depth")
    found = None
    for hop in range(1, depth + 1):
        next_ = front.where(F.col("max_depth") >= hop).join(edges, "node_id").select("query_id", F.col("prerequisite").alias("node_id"), F.concat("path", F.array("at")).alias("path"), "max_depth")
        next_ = next_.groupBy("query_id", "node_id").agg(F.min("path").alias("path"), F.first("max_depth").alias("max_depth"))
        next_ = next_.join(own, (F.col("query_id") == F.col("own_query")) & (F.col("node_id") == F.col("root")), "left").drop("own_query")
        if hop == 1:
            kept = next_.where("root IS NULL OR element_at(path, 1) < own_at")
        else:
            kept = next_.where("root IS NULL").join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        kept = written(kept)
        front = kept.where("root IS NULL").select("query_id", "node_id", "path", "max_depth")
        level = kept.select("query_id", "node_id", F.lit(hop).alias("depth"), "path")
        found = level if found is None else found.unionByName(level)
    return found


def unsupported(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """Nodes that no row of uses (node_id) supports."""
    return nodes.join(uses.select("node_id"), "node_id", "left_anti")
