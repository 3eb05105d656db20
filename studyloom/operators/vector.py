"""Vector channel: exact inner-product search of a flat index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import inner_product

#: Queries that one pass over the index answers at most, about; more are answered in several passes.
BATCH = 4096
#: Characters of a text that the stand-in encoder takes at a time.
PIECE = 1 << 14


def search(queries: DataFrame, index: DataFrame, k: int = 30, exclude_self: bool = False) -> DataFrame:
    """(query_id, pos, score, rank): queries (query_id, vector) against index (pos, embedding).

    Queries are counted and sent to the index's partitions in parts of about BATCH / 2 rows, dealt by hash; each partition keeps its own k
    best before anything is shuffled. For small indexes; operators.vector_index is for large ones.
    """
    found = None
    n = queries.count()
    parts = 1 if n <= BATCH else -(-2 * n // BATCH)
    for part in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        pairs = index.join(F.broadcast(some), (F.col("pos") != F.col("query_id")) if exclude_self else None)
        scored = pairs.select("query_id", "pos", F.round(inner_product(F.col("vector"), F.col("embedding")), 6).alias("score"))
        found = scored if found is None else found.unionByName(scored)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def with_meta(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits joined by position to their metadata, after ranking: a hit without metadata leaves a gap."""
    return hits.join(meta, "pos")


def hashed_encoder(dimension: int = 64) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """A stand-in text encoder: signed hashed character trigrams, of unit norm. Deterministic, no model file."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dimension)
                text = f"  {t or ''} "
                # long texts in pieces that share two characters: a number for each character is many times the text
                for at in range(0, len(text) - 2, PIECE):
                    points = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                    h = points[:-2] * np.uint64(1000003) + points[1:-1] * np.uint64(8191) + points[2:]
                    h = (h ^ (h >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
                    np.add.at(v, (h >> np.uint64(40)).astype(np.int64) % dimension, np.where(h & np.uint64(1 << 39), 1.0, -1.0))
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.Series(out)

    return encode


def encode(df: DataFrame, text: str = "text", prefix: str = "", dimension: int = 64, encoder: Callable | None = None) -> DataFrame:
    """df with vector (array<float>) of prefix + text; the encoder runs in Arrow batches, loaded once a worker."""
    udf = F.pandas_udf(encoder or hashed_encoder(dimension), "array<float>")
    return df.withColumn("vector", udf(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))
