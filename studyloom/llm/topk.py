"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector is cut into ``LISTS`` runs of components. For a query each run is a list of local
scores (the partial inner products of all candidates), and a candidate's score is the sum over
the lists. Candidates and queries stand in blocks of bounded size; a query block meets a
candidate block once per phase.

1. Every pair of blocks reads the k + 1 best entries of each local list and adds up the scores
   of the candidates seen, of these only. The k + 1 best sums of a query over all blocks are scores that
   exist, so the least of them is a safe cutoff: it travels with its query block.
2. With the lists' least values as zero, a candidate whose local scores all lie under
   (cutoff - sum of zeros) / lists has a sum under the cutoff. So each list collects its entries
   at or over that uniform threshold; what no list collects is never added up.
3. The remaining scores of the collected candidates are resolved exactly, those under the cutoff
   dropped, and the k + 1 best of a block pair passed on to the final ranking.

Components become floor(64 * x). Blocks hold them in the smallest type that fits (1, 2, 4 or 8 bytes); those
beyond 8 bytes stand as the components themselves. Products are taken in float32 or float64 only while every
partial sum is a whole number below 2**24 or 2**53, else in Python integers.

Cases: vectors that are null, or hold a null or a non-finite component, take no part; a null vec_id takes
no part; vectors of other length than the query's
are no candidates; ties go to the smaller vec_id; a row is no candidate of its own, but a repeated
row is one of its copies; fewer than k candidates are returned all; an empty table gives no rows;
a score beyond long can't stand in the column and shows as its bound, but ranks by its exact value.

The number of block pairs grows with queries times candidates, as any exact search over all
pairs does; query blocks travel to the candidate blocks, so a candidate moves once a phase. The memory of a task is two blocks
and a slice of their product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read

#: Two lists: the more there are, the lower the threshold stands in each, and the more candidates some list collects.
K, EVERY, LISTS = 20, 20, 2
CANDIDATES, QUERIES, SLICE = 16384, 512, 4096
BLOCK = "block long, dim int, ids binary, ints binary, kind string, largest double"
#: order: the exact score as text that sorts like it, where it is beyond long.
HIT = "query_id long, query_nr long, vec_id long, own boolean, score long, order string, total double"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))


def _packed(rows: list[np.ndarray], dim: int) -> tuple[bytes, str, float]:
    """Bytes, type and largest absolute value of the integer components; type raw: components that are beyond long as integers."""
    x = np.array(rows, np.float64).reshape(len(rows), dim)
    if np.abs(x).max(initial=0) >= 2.0**56:
        return x.tobytes(), "raw", float("inf")
    ints = np.floor(64 * x)
    most = float(np.abs(ints).max(initial=0))
    kind = next(k for k, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 2.0**bits)
    return ints.astype(kind).tobytes(), kind, most


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of vectors packed into blocks of at most size rows of one length."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nr, waiting = TaskContext.get().partitionId() << 32, {}

        def out(dim: int, rows: list) -> pd.DataFrame:
            nonlocal nr
            nr += 1
            ids = np.array([r[0] for r in rows], np.int64)
            return pd.DataFrame([(nr, dim, ids.tobytes(), *_packed([r[1] for r in rows], dim))], columns=["block", "dim", "ids", "ints", "kind", "largest"])

        for frame in frames:
            for i, v in zip(frame["vec_id"], frame["embedding"], strict=True):
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield out(len(v), waiting.pop(len(v)))
        for dim, rows in waiting.items():
            yield out(dim, rows)

    return vectors.mapInPandas(pack, BLOCK)


def _unpack(ids: bytes, ints: bytes, kind: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    if kind != "raw":
        return i, np.frombuffer(ints, kind).reshape(len(i), dim)
    raw = np.frombuffer(ints, np.float64)
    # from 2**53 on a double is a whole number, and 64 times as much might be beyond double
    exact = [int(x) * 64 if abs(x) >= 2.0**53 else math.floor(64 * x) for x in raw.tolist()]
    return i, np.array(exact, object).reshape(len(i), dim)


def _edges(dim: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, LISTS + 1).astype(int).tolist()
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def local_lists(q: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """Local score lists: for each run of components, queries x candidates."""
    for a, b in _edges(q.shape[1]):
        yield q[:, a:b] @ c[:, a:b].T


def sums(q: np.ndarray, c: np.ndarray, at_q: np.ndarray, at_c: np.ndarray) -> np.ndarray:
    """Whole scores of the collected pairs only."""
    if q.dtype == object:
        return np.array([int(sum(x * y for x, y in zip(q[i].tolist(), c[j].tolist(), strict=True))) for i, j in zip(at_q.tolist(), at_c.tolist(), strict=True)], object)
    out = np.empty(len(at_q), q.dtype)
    for a in range(0, len(at_q), 1 << 16):
        out[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[at_q[a : a + (1 << 16)]], c[at_c[a : a + (1 << 16)]])
    return out


def _lower(bound: np.ndarray) -> np.ndarray:
    """A little less, so that rounding can't cut; minus infinity (no cutoff) stays."""
    return np.where(np.isfinite(bound), bound - np.abs(np.where(np.isfinite(bound), bound, 0)) * 1e-9 - 1e-9, bound)


def _whole(bound: np.ndarray) -> list[int]:
    """Cutoffs as Python integers, a little less; none is less than any score."""
    return [-(10**640) if not np.isfinite(b) else int(b) - abs(int(b)) // 10**9 - 1 for b in bound]


def collected(q: np.ndarray, c: np.ndarray, k: int, cutoff: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that some local list collects: its k + 1 best (phase 1), or its entries over the uniform threshold (phase 2)."""
    seen = np.zeros((len(q), len(c)), bool)
    if not _edges(q.shape[1]) or cutoff is None and len(c) <= k + 1:
        seen[:] = True
    elif cutoff is None:
        for part in local_lists(q, c):
            best = np.argpartition(part, len(c) - k - 1, axis=1)[:, len(c) - k - 1 :]
            np.put_along_axis(seen, best, True, axis=1)
    else:
        lists = list(local_lists(q, c))
        zeros = [part.min(axis=1) for part in lists]
        if q.dtype == object:
            threshold = [b - sum(int(z[i]) for z in zeros) for i, b in enumerate(_whole(cutoff))]
            for part, zero in zip(lists, zeros, strict=True):
                seen |= np.array([[(int(p) - int(z)) * len(lists) >= t for p in own] for own, z, t in zip(part, zero, threshold, strict=True)], bool)
        else:
            threshold = _lower((cutoff - sum(z.astype(float) for z in zeros)) / len(lists))
            for part, zero in zip(lists, zeros, strict=True):
                seen |= part >= (threshold + zero)[:, None]
    return np.nonzero(seen)


def _sortable(score: int) -> str:
    """Digits behind their number, complemented for negative scores: text that sorts like the score."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _hits(row, q_ids, q, c_ids, c, at_q, at_c, score, k: int) -> pd.DataFrame:
    """The k + 1 best of each query, in order of score and vec_id, as rows."""
    order = np.lexsort((c_ids[at_c], -score, at_q))
    at_q, at_c, score = at_q[order], at_c[order], score[order]
    best = np.arange(len(at_q)) - np.searchsorted(at_q, at_q, side="left") <= k
    at_q, at_c, score = at_q[best], at_c[best], score[best]
    own = (q_ids[at_q] == c_ids[at_c]) & (q[at_q] == c[at_c]).all(axis=1)
    if score.dtype == object:
        limit = 1 << 63
        whole, text = [max(-limit, min(limit - 1, s)) for s in score], [_sortable(s) if not -limit <= s < limit else None for s in score]
        total = [float(max(min(s, 10**308), -(10**308))) for s in score]
    else:
        whole, text, total = score.astype(np.int64), None, score.astype(float)
    out = {"query_id": q_ids[at_q], "query_nr": row.q_block * QUERIES + at_q, "vec_id": c_ids[at_c], "own": own.astype(bool), "score": np.array(whole, np.int64), "order": pd.Series(text, dtype=object, index=range(len(at_q))), "total": np.array(total, float)}
    return pd.DataFrame(out)


def _phase(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1 where pairs has no cutoffs, else phases 2 and 3."""
    with_cutoff = "cutoffs" in pairs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q_ids, q_ints = _unpack(row.q_ids, row.q_ints, row.q_kind, row.dim)
                all_ids, all_ints = _unpack(row.ids, row.ints, row.kind, row.dim)
                bound = float(row.q_largest) * float(row.largest) * row.dim + 1
                kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
                q = q_ints.astype(kind)
                cutoff = None
                if with_cutoff:
                    cutoff = np.full(len(q), -np.inf)
                    for nr, value in row.cutoffs.items() if isinstance(row.cutoffs, dict) else row.cutoffs:
                        cutoff[nr - row.q_block * QUERIES] = value
                found = []
                for at in range(0, len(all_ids), SLICE):
                    c_ids, c = all_ids[at : at + SLICE], all_ints[at : at + SLICE].astype(kind)
                    at_q, at_c = collected(q, c, k, cutoff)
                    score = sums(q, c, at_q, at_c)
                    if with_cutoff:
                        enough = np.array([x >= y for x, y in zip(score, np.array(_whole(cutoff), object)[at_q], strict=True)], bool) if kind is object else score >= _lower(cutoff)[at_q]
                        at_q, at_c, score = at_q[enough], at_c[enough], score[enough]
                    found.append((at_q, at_c + at, score))
                at_q, at_c, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _hits(row, q_ids, q_ints, all_ids, all_ints, at_q, at_c, score, k)

    return pairs.mapInPandas(run, HIT)


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every vector for which is_query holds."""
    keep = Scratch(spark)
    vectors = valid_vectors(vectors.select("vec_id", "embedding"))
    n = spark.sparkContext.defaultParallelism
    candidates = keep.save(blocks(vectors, CANDIDATES), "candidates")
    queries = blocks(vectors.where(is_query), QUERIES).select(F.col("block").alias("q_block"), "dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "ints", "kind", "largest")])
    queries = keep.save(queries, "queries")
    # every query block meets every candidate block of its length: numbers only, and each query block's number stands
    # under every salt, so that the one key of a table of equal lengths is dealt over n tasks
    salted = candidates.select("block", "dim", F.pmod(F.xxhash64("block"), F.lit(n)).alias("salt"))
    asked = queries.select("q_block", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("salt"))
    met = keep.save(asked.join(salted, ["dim", "salt"]).select("q_block", "block"), "met")

    def pairs(side: DataFrame) -> DataFrame:
        # the query block is the smaller row: it is joined first and travels
        return met.join(side.drop("dim"), "q_block").repartition(8 * n, "block").join(candidates, "block")

    best = W.partitionBy("query_nr").orderBy(F.desc("score"), F.coalesce("order", F.when(F.col("score") > 0, "").otherwise("2")).desc(), "vec_id")
    ranked = _phase(pairs(queries), k).withColumn("nr", F.row_number().over(best)).where(F.col("nr") == k + 1)
    cutoffs = ranked.groupBy((F.col("query_nr") / QUERIES).cast("long").alias("q_block")).agg(F.map_from_entries(F.collect_list(F.struct("query_nr", "total"))).alias("cutoffs"))  # at most QUERIES a block
    cut = keep.save(queries.join(cutoffs, "q_block", "left").withColumn("cutoffs", F.coalesce("cutoffs", F.expr("cast(map() as map<bigint,double>)"))), "cut")
    found = _phase(pairs(cut), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    # of the k + 1 best one may be the query's own row
    own = F.min(F.when(F.col("own"), F.col("rank"))).over(W.partitionBy("query_nr"))
    found = found.withColumn("own_rank", own).where(F.col("own_rank").isNull() | (F.col("rank") != F.col("own_rank")))
    rank = F.col("rank") - F.when(F.col("rank") > F.col("own_rank"), 1).otherwise(0)
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
