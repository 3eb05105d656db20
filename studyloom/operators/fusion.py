"""Weighted reciprocal-rank fusion of channels, and the rerank by signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fuzzy_contains

K = 60
WEIGHTS = {"vector": 0.5, "tag": 0.3, "tfidf": 0.2}
BONUS = {"brand": 0.05, "warning": 0.03, "preview": 0.02, "topics": 0.02}


def fuse(channels: list[DataFrame], weights: dict[str, float] = WEIGHTS, k: int = K) -> DataFrame:
    """(query_id, chunk_id, first_channel, rrf_score, fused_rank) from hits (query_id, chunk_id, rank, channel).

    A hit without rank counts as the last of its channel. Ties of the sum (9 digits) stand as the channels do, then by rank.
    Rows without chunk_id are dropped.
    """
    names = list(weights)
    hits = None
    for c in channels:
        own = c.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "channel")
        hits = own if hits is None else hits.unionByName(own)
    number = F.coalesce(*[F.when(F.col("channel") == n, i) for i, n in enumerate(names)])
    weight = F.coalesce(*[F.when(F.col("channel") == n, F.lit(w)) for n, w in weights.items()])
    rank = F.coalesce("rank", F.count("*").over(W.partitionBy("query_id", "channel")))
    hits = hits.withColumn("at", rank).where("chunk_id IS NOT NULL").withColumn("nr", number).withColumn("weight", weight)
    fused = hits.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("at"))), 9).alias("rrf_score"),
        F.min(F.struct("nr", "at", "channel")).alias("first"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first.nr", "first.at")
    return fused.select("query_id", "chunk_id", F.col("first.channel").alias("first_channel"), "rrf_score", F.row_number().over(order).alias("fused_rank"))


def bonus(query: Column) -> Column:
    """Sum of the signals' bonuses, for columns has_brand_signal, has_warning, text_preview, topics."""
    topics = F.array_join(F.coalesce("topics", F.expr("cast(array() as array<string>)")), " ")

    def signal(c: Column, name: str) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), F.lit(BONUS[name])).otherwise(F.lit(0.0))

    preview = fuzzy_contains(query, F.substring("text_preview", 1, 200))
    near = fuzzy_contains(topics, query) | fuzzy_contains(query, topics)
    return F.round(signal(F.col("has_brand_signal"), "brand") + signal(F.col("has_warning"), "warning") + signal(preview, "preview") + signal(near, "topics"), 2)


def last_rows(chunks: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each chunk_id, the last by order (by default in the order of reading)."""
    at = order if order is not None else F.monotonically_increasing_id()
    other = [c for c in chunks.columns if c != "chunk_id"]
    last = chunks.select("chunk_id", F.struct(*other).alias("__row"), at.alias("__at")).groupBy("chunk_id").agg(F.max_by("__row", "__at").alias("__row"))
    return last.select("chunk_id", "__row.*")


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """fused with the chunk's columns, rerank_bonus, final_score and final_rank; ties keep the fused order. Of chunks that share an id the last counts."""
    joined = fused.join(last_rows(chunks), "chunk_id", "left").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    scored = joined.withColumn("rerank_bonus", bonus(F.col("query_text"))).withColumn("final_score", F.round(F.col("rrf_score") + F.col("rerank_bonus"), 9))
    order = W.partitionBy("query_id").orderBy(F.desc("final_score"), "fused_rank")
    return scored.withColumn("final_rank", F.row_number().over(order))


def retrieve(channels: list[DataFrame], chunks: DataFrame, queries: DataFrame, top_k: int = 10, filters: Column | None = None) -> DataFrame:
    """The top_k chunks of each query after fusion and rerank. filters restrict chunks before they are ranked."""
    if filters is not None:
        allowed = chunks.where(filters)
        channels = [c.join(allowed.select("chunk_id"), "chunk_id", "left_semi") for c in channels]
    return rerank(fuse(channels), chunks, queries).where(F.col("final_rank") <= top_k)
