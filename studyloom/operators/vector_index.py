"""A stored vector index: vectors clustered round centres, and an exact inner-product search that reads only clusters that can matter.

Tables of an index, under one folder: ``vectors`` (cluster, part, pos, embedding, a folder a cluster), ``clusters`` (cluster, centre, n, parts, radius,
norm, angle) and ``meta``, written last. Centres come from a bounded sample (``SAMPLE`` vectors of the least hashes, some rounds of k-means in
numpy); every vector is then put to its nearest centre. A cluster keeps its greatest distance from the centre (radius), greatest norm and greatest
angle to the centre. For a query q no vector x of the cluster has more than either bound:

    q.x <= q.c + |q| radius        q.x <= |q| norm cos(max(0, angle(q, c) - greatest angle))

A search first reads for each query the clusters with the highest bounds that hold k vectors between them, which gives a score that
its k-th best reaches at least, and then the clusters whose bound isn't below that. Clusters number at most ``CLUSTERS``, so their
table is small whatever the index holds; a cluster's vectors are dealt over parts of about ``PART``, so that a cluster of a third of
all vectors is many tasks. Queries are dealt over groups of ``QUERIES`` in the same way.

Vectors without direction help little in many dimensions: there all bounds are alike and all clusters are read, at the cost of a plain search.

Cases: null vectors and null positions take no part; vectors with nulls or of another length than most are refused by ``write_index``; zero vectors are kept; ties go to
the smaller pos; an empty index gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import exists
from ..sources.scratch import written

SAMPLE, CLUSTERS, ROUNDS = 20_000, 1024, 8
PART, QUERIES, ROWS = 8192, 2048, 1024
#: Scores have 6 digits: a bound is out only if it stays below by more than rounding can add.
MARGIN = 2e-6


class Index(NamedTuple):
    vectors: DataFrame
    clusters: DataFrame


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; some rows at a time, as all rows' products with all centres are many times the rows."""
    half = (centres * centres).sum(axis=1) / 2
    parts = [np.argmax(m[at : at + ROWS] @ centres.T - half, axis=1) for at in range(0, len(m), ROWS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def centres_of(sample: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means from the first vectors of the sample; a centre that loses its vectors stays where it is."""
    centres = sample[:clusters].copy()
    for _ in range(rounds if len(sample) else 0):
        near = _nearest(sample, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def sampled(rows: DataFrame, size: int, n: int) -> pa.ChunkedArray:
    """The embeddings of the least hashes of n rows (pos, embedding), in order. Only rows below a hash that twice as many stay under are sorted, as all tasks' best meet in one; if these are too few, all are."""
    key = F.xxhash64("pos")
    under = rows.where(key <= -(1 << 63) + (1 << 64) * 2 * size // n) if n > 2 * size else rows
    for some in (under, rows):
        out = some.orderBy(key, "pos").select("embedding").limit(size).toArrow().column("embedding")
        if len(out) >= min(size, n):
            break
    return out


def write_index(vectors: DataFrame, path: str, clusters: int | None = None, part: int = PART) -> None:
    """Index vectors (pos, embedding) under path, which must be new. clusters: about the root of their number, unless given, at most CLUSTERS."""
    spark = vectors.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    rows = vectors.where("pos IS NOT NULL AND embedding IS NOT NULL").select("pos", F.col("embedding").cast("array<float>").alias("embedding"))
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.bool_or(F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).alias("holes")).first()
    if shape.n and (shape.least != shape.most or shape.holes):
        raise ValueError("vectors of an index have one length and no holes")
    sample = _matrix(sampled(rows, SAMPLE, shape.n))
    centres = centres_of(sample, min(clusters or max(1, round(shape.n**0.5)), CLUSTERS))
    out = pa.schema([("cluster", pa.int32()), ("pos", pa.int64()), ("embedding", pa.list_(pa.float32())), ("distance", pa.float64()), ("norm", pa.float64()), ("cosine", pa.float64())])
    lengths = np.linalg.norm(centres, axis=1) if len(centres) else np.zeros(0)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            if len(m):
                near = _nearest(m, centres)
                norm = np.linalg.norm(m, axis=1)
                scale = norm * lengths[near]
                cosine = np.where(scale > 0, np.einsum("ij,ij->i", m, centres[near]) / np.where(scale > 0, scale, 1), -1)
                columns = [pa.array(near.astype(np.int32)), batch.column(0).cast(pa.int64()), batch.column(1), pa.array(np.linalg.norm(m - centres[near], axis=1)), pa.array(norm), pa.array(cosine)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    placed = written(rows.mapInArrow(put, "cluster int, pos long, embedding array<float>, distance double, norm double, cosine double"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm"), F.min("cosine").alias("cosine"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cluster int, centre array<double>")
    # at most CLUSTERS rows, in one file
    table = written(sizes.join(F.broadcast(known), "cluster").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")))).coalesce(1))
    table.coalesce(1).write.parquet(f"{path}/clusters")
    dealt = placed.join(F.broadcast(table.select("cluster", "parts")), "cluster").withColumn("part", F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int"))
    dealt.select("cluster", "part", "pos", "embedding").repartition("cluster", "part").write.partitionBy("cluster").parquet(f"{path}/vectors")
    spark.range(1).write.parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> Index:
    """A complete index; one whose writing was cut short is refused."""
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        raise FileNotFoundError(f"{path} holds no complete index")
    clusters = spark.read.parquet(f"{path}/clusters")
    if clusters.isEmpty():
        return Index(spark.createDataFrame([], "part int, pos long, embedding array<float>, cluster int"), clusters)
    return Index(spark.read.schema("part int, pos long, embedding array<float>, cluster int").parquet(f"{path}/vectors"), clusters)


def bounds(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, cluster, bound, n, parts: for each query all clusters with the most that a vector of theirs can score."""
    table = index.clusters.orderBy("cluster").toArrow()  # at most CLUSTERS rows
    centres = _matrix(table.column("centre"))
    cluster, n, parts, radius, norm, angle = (table.column(c).to_numpy() for c in ("cluster", "n", "parts", "radius", "norm", "angle"))
    lengths = np.linalg.norm(centres, axis=1) if len(centres) else np.zeros(0)
    out = pa.schema([("query_id", pa.int64()), ("cluster", pa.int32()), ("bound", pa.float64()), ("n", pa.int64()), ("parts", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q = _matrix(batch.column(1))
                if not len(centres) or not len(q):
                    continue
                own = np.linalg.norm(q, axis=1)[:, None]
                dot = q @ centres.T
                scale = own * lengths
                between = np.arccos(np.clip(np.where(scale > 0, dot / np.where(scale > 0, scale, 1), 1), -1, 1))
                turned = own * norm * np.cos(np.maximum(0, between - angle))
                bound = np.minimum(dot + own * radius, np.maximum(turned, 0)) + 1e-9 * (1 + np.abs(dot))
                ids = np.repeat(batch.column(0).cast(pa.int64()).to_numpy(), len(cluster))
                columns = [ids, np.tile(cluster, len(q)), bound.ravel(), np.tile(n, len(q)), np.tile(parts, len(q))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

    return queries.where("vector IS NOT NULL AND query_id IS NOT NULL").select("query_id", "vector").mapInArrow(run, "query_id long, cluster int, bound double, n long, parts int")


def _scored(wanted: DataFrame, queries: DataFrame, index: Index, k: int, exclude_self: bool) -> DataFrame:
    """query_id, pos, score: of each wanted (query_id, cluster, parts) the k best a part of the cluster."""
    asked = wanted.select("query_id", "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(queries, "query_id")
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(64)).cast("int"))
    # a part that more queries ask for than a group takes is sent to several
    load = asked.groupBy("cluster", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("deals"))
    asked = asked.join(load, ["cluster", "part"]).withColumn("deal", F.pmod("deal", F.col("deals")))
    held = index.vectors.join(load, ["cluster", "part"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    out = pa.schema([("query_id", pa.int64()), ("pos", pa.int64()), ("score", pa.float64())])

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, pos = asked.column("query_id").to_numpy(), held.column("pos").to_numpy()
        order = np.argsort(pos)  # so that ties go to the smaller one
        pos, m = pos[order], _matrix(held.column("embedding"))[order]
        q = _matrix(asked.column("vector"))
        found: list[list] = [[], [], []]
        for i in range(0, len(ids), 256):
            score = np.round(q[i : i + 256] @ m.T, 6) if len(m) else np.zeros((len(ids[i : i + 256]), 0))
            for one, row in zip(ids[i : i + 256].tolist(), score, strict=True):
                if exclude_self:
                    row[pos == one] = -np.inf
                top = np.argsort(-row, kind="stable")[:k]
                top = top[row[top] > -np.inf]
                found[0].append(np.full(len(top), one))
                found[1].append(pos[top])
                found[2].append(row[top])
        columns = [np.concatenate(f) if f else np.zeros(0) for f in found]
        return pa.table([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    # a column of its own, which no join before has dealt either side by
    cell = F.concat_ws("-", "cluster", "part", "deal").alias("cell")
    sides = asked.select(cell, "query_id", "vector"), held.select(cell, "pos", "embedding")
    return sides[0].groupBy("cell").cogroup(sides[1].groupBy("cell")).applyInArrow(best, "query_id long, pos long, score double")


def plan(queries: DataFrame, index: Index, k: int, exclude_self: bool = False) -> DataFrame:
    """bounds with first: whether the cluster is among those with the highest bounds that hold k vectors between them."""
    order = W.partitionBy("query_id").orderBy(F.desc("bound"), "cluster")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return bounds(queries, index).withColumn("first", before < k + int(exclude_self))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int = 30, exclude_self: bool = False) -> DataFrame:
    """(query_id, pos, score, rank): the k best of each of queries (query_id, vector), as operators.vector.search gives them."""
    return _searched(queries, index, k, exclude_self)[0]


def _searched(queries: DataFrame, index: Index, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """The result, and for each query the clusters with read: whether they were read."""
    own = written(queries.where("vector IS NOT NULL AND query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "vector"))
    planned = written(plan(own, index, k, exclude_self))
    first = written(_ranked(_scored(planned.where("first"), own, index, k, exclude_self), k))
    reach = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("reach")).where(F.col("c") == k)
    rest = planned.join(reach.select("query_id", "reach"), "query_id", "left")
    rest = rest.withColumn("read", F.col("first") | (F.col("bound") >= F.coalesce(F.col("reach") - MARGIN, F.lit(float("-inf")))))
    more = _scored(rest.where("read AND NOT first"), own, index, k, exclude_self)
    return _ranked(first.select("query_id", "pos", "score").unionByName(more), k), rest


def reads(queries: DataFrame, index: Index, k: int = 30, exclude_self: bool = False) -> DataFrame:
    """query_id, n_clusters, n_read, n_vectors, n_compared: how much of the index each query reads."""
    rest = _searched(queries, index, k, exclude_self)[1]
    return rest.groupBy("query_id").agg(F.count("*").alias("n_clusters"), F.count_if("read").alias("n_read"), F.sum("n").alias("n_vectors"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("n_compared"))
