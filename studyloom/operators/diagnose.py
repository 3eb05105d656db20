"""Retrieval with diagnosis: one row for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import classify, graph

NODES, PATTERNS, TECHNIQUES, CHUNKS, VIDEOS = 3, 2, 3, 8, 5


def lookup(hits: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """hits with the dimension's columns (one row a key), defaults where it lacks the key or holds null."""
    joined = hits.join(dimension, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def first_match(hits: DataFrame, dimension: DataFrame, key: str, order: str) -> DataFrame:
    """hits joined to the first row of the dimension for each key."""
    nr = F.row_number().over(W.partitionBy(key).orderBy(order))
    return hits.join(dimension.withColumn("__nr", nr).where("__nr = 1").drop("__nr"), key)


def videos(ranked: DataFrame, n: int = VIDEOS, order: str = "final_rank") -> DataFrame:
    """The first n distinct (video_id, part_no) of each query, in order of rank; an empty video_id is none."""
    rows = ranked.where(F.coalesce("video_id", F.lit("")) != "").withColumn("part_no", F.coalesce("part_no", F.lit(1)))
    first = F.row_number().over(W.partitionBy("query_id", "video_id", "part_no").orderBy(order))
    rows = rows.withColumn("__first", first).where("__first = 1").drop("__first")
    return rows.withColumn("video_rank", F.row_number().over(W.partitionBy("query_id").orderBy(order))).where(F.col("video_rank") <= n)


def listed(rows: DataFrame, order: str, value: Column, n: int, name: str) -> DataFrame:
    """query_id, name: the values of the first n rows of each query as an array in order."""
    some = rows.where(F.col(order) <= n).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v")))).alias("r"))
    return some.select("query_id", F.transform("r", lambda x: x["v"]).alias(name))


def diagnose(queries: DataFrame, node_hits: DataFrame, pattern_hits: DataFrame, technique_hits: DataFrame, ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, text, grade, complexity, related_nodes, missing_prereqs, prereq_chain, exam_patterns, techniques, chunks, videos.

    Hits are (query_id, node_id / pattern_id / technique_id, rank) after ranking; ranked are reranked chunks; edges those of the graph.
    """
    out = queries.select("query_id", "text").withColumn("grade", classify.grade(F.col("text"))).withColumn("complexity", classify.complexity(F.col("text")))
    roots = node_hits.where(F.col("rank") <= NODES).join(out.select("query_id", classify.depth_of(F.col("grade")).alias("max_depth")), "query_id")
    traced = graph.trace(roots.select("query_id", (F.col("rank") - 1).alias("root_at"), "node_id", "max_depth"), edges)
    chain = traced.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("depth", "path", "node_id"))).alias("r")).select("query_id", F.transform("r", lambda x: x["node_id"]).alias("prereq_chain"))
    fields = ("chunk_id", "video_id", "part_no", "video_title", "collection", "short_title", "text_preview")
    parts = [
        listed(node_hits, "rank", F.col("node_id"), NODES, "related_nodes"),
        chain,
        listed(pattern_hits, "rank", F.col("pattern_id"), PATTERNS, "exam_patterns"),
        listed(technique_hits, "rank", F.col("technique_id"), TECHNIQUES, "techniques"),
        listed(ranked, "final_rank", F.struct(*fields), CHUNKS, "chunks"),
        listed(videos(ranked.where(F.col("final_rank") <= CHUNKS)), "video_rank", F.struct(*fields), VIDEOS, "videos"),
    ]
    for p in parts:
        out = out.join(p, "query_id", "left")
    for c in ("related_nodes", "prereq_chain", "exam_patterns", "techniques", "chunks", "videos"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.from_json(F.lit("[]"), out.schema[c].dataType)))
    most = F.when(F.col("grade") == "first", 2).otherwise(3)
    return out.withColumn("missing_prereqs", F.slice("prereq_chain", F.lit(1), most))
