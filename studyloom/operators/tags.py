"""Tag channel: chunks by the topics and patterns that a query names or resembles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fuzzy_holders, fuzzy_pairs

#: Points in hundredths, so that equal totals are equal: matched topic, matched pattern, resembling topic, pattern.
POINTS = {"topic": 50, "pattern": 30, "near_topic": 20, "near_pattern": 15}


def node_aims(nodes: DataFrame) -> DataFrame:
    """(node_id, target): a node's id, and the causes and symptoms of its failures."""
    failures = nodes.select("node_id", F.explode("common_failures").alias("f"))
    aims = nodes.select("node_id", F.col("node_id").alias("target")).union(failures.select("node_id", "f.cause")).union(failures.select("node_id", "f.symptom"))
    return aims.where("target <> ''").distinct()


def pattern_aims(patterns: DataFrame) -> DataFrame:
    """(pattern_id, target): a pattern's id and its variants' names."""
    variants = patterns.select("pattern_id", F.explode("question_variants").alias("v")).select("pattern_id", "v.variant_name")
    return patterns.select("pattern_id", F.col("pattern_id").alias("target")).union(variants).where("target <> ''").distinct()


def matched(queries: DataFrame, aims: DataFrame, key: str) -> DataFrame:
    """(query_id, key): the query resembles one of the key's targets."""
    return fuzzy_pairs(queries, aims).join(aims, "target").select("query_id", key).distinct()


def search(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, patterns: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, chunk_id, score (hundredths), rank, channel). A tag counts as often as a chunk holds it; ties by chunk_id.

    All targets (tags, ids, causes, symptoms, variant names) are compared with the queries in one join, which is used once.
    """
    tags = None
    for kind, column in (("topic", "topics"), ("pattern", "patterns")):
        own = chunks.select("chunk_id", F.lit(kind).alias("kind"), F.explode(column).alias("tag"))
        tags = own if tags is None else tags.unionByName(own)
    tags = tags.groupBy("kind", "tag", "chunk_id").agg(F.count("*").alias("times"))
    # what a matching target is worth: points for the node or pattern that it is of, and for tags that are called so
    aims = None
    for rows, kind, tag, name in (
        (node_aims(nodes), "topic", "node_id", "topic"), (pattern_aims(patterns), "pattern", "pattern_id", "pattern"),
        (tags.where("kind = 'topic'").select("tag", F.col("tag").alias("target")), "topic", "tag", "near_topic"), (tags.where("kind = 'pattern'").select("tag", F.col("tag").alias("target")), "pattern", "tag", "near_pattern"),
    ):
        own = rows.select("target", F.lit(kind).alias("kind"), F.col(tag).alias("tag"), F.lit(POINTS[name]).alias("points"))
        aims = own if aims is None else aims.unionByName(own)
    aims = aims.distinct()
    # several targets of one node or pattern count once; queries stay in arrays
    met = fuzzy_holders(queries, aims).join(aims, "target").groupBy("kind", "tag", "points", "batch").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    worth = met.join(tags, ["kind", "tag"]).select("chunk_id", (F.col("points") * F.col("times")).alias("points"), "batch", "ids")
    scored = _block_best(worth, max(1, -(-chunks.count() // BLOCK)), k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("channel", F.lit("tag"))


#: Chunks whose points are summed together, about, for all queries of a batch.
BLOCK = 512


def _block_best(worth: DataFrame, blocks: int, k: int) -> DataFrame:
    """query_id, chunk_id, score: of each block of chunks the k best of each query, from worth (chunk_id, points, batch, ids).

    The points of a block are summed in a table of chunks by queries, so pairs of both are no rows; what goes on is k a block and query at most.
    """
    chunk_type = worth.schema["chunk_id"].dataType.simpleString()
    query_type = worth.schema["ids"].dataType.elementType.simpleString()

    def best(rows: pa.Table) -> pa.Table:
        ids = rows.column("ids").combine_chunks()
        flat = ids.flatten().dictionary_encode()
        length = ids.value_lengths().to_numpy()
        names = sorted(set(rows.column("chunk_id").to_pylist()))  # so that ties go to the smaller one
        at = {c: i for i, c in enumerate(names)}
        chunk = np.repeat(np.array([at[c] for c in rows.column("chunk_id").to_pylist()], np.int64), length)
        sums = np.zeros((len(flat.dictionary), len(names)), np.int64)
        np.add.at(sums, (flat.indices.to_numpy(), chunk), np.repeat(rows.column("points").to_numpy(), length))
        top = np.argsort(-sums, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(sums, top, axis=1)
        query = np.repeat(np.arange(len(sums)), top.shape[1])
        some = np.flatnonzero(score.ravel() > 0)
        columns = [flat.dictionary.take(pa.array(query[some])), pa.array(names, rows.schema.field("chunk_id").type).take(pa.array(top.ravel()[some])), pa.array(score.ravel()[some])]
        return pa.table(columns, names=["query_id", "chunk_id", "score"])

    block = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("block")
    return worth.where("chunk_id IS NOT NULL").select(block, "*").groupBy("block", "batch").applyInArrow(best, f"query_id {query_type}, chunk_id {chunk_type}, score long")
