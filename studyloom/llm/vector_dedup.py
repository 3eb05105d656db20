"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosines and connected components.

Equal vectors are one class, so copies are hashed and compared once. Each of several tables keeps
``bits`` signs of products with random hyperplanes as a class's key. Signs agree with a chance of
p = 1 - angle / pi each, so a pair at the threshold shares a key somewhere with a chance of
1 - (1 - p**bits)**tables: ``parameters`` takes bits near the logarithm of the number of classes,
which keeps buckets small, and as many tables as ``MISS`` asks for. Pairs above the threshold are
missed more seldom.

Keys that one class alone has are dropped before a vector moves. The others make cells: a bucket of
more than ``BLOCK`` classes is cut into blocks, and each pair of its blocks is a cell of its own, so
the largest bucket is many tasks of bounded size. A cell's cosines are computed in double precision
from the vectors. A pair that shares several tables' keys counts in the first of them. No pair
leaves its task: out go the number of links of each class and a spanning star of what is connected,
from which the components are found over all cells.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
their component is their own vec_id; so do vectors of different lengths among each other. A null
vec_id takes no part: no links, null component, not kept. Rows that share a vec_id are one vector in
components and in what links with others; copies count by row. An empty table gives no rows; other
columns are ignored, vec_id is a whole number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, read
from .jaccard_join import components

THRESHOLD = 0.95
#: A pair just at the threshold may be missed with this chance.
MISS = 0.001
#: Signs a table takes at least; classes of a bucket that one side of a cell holds.
LEAST_BITS, BLOCK = 12, 4096
SEED = 20240613

#: Groups up to SMALL rows are compared together, PAIRS pairs at a time; larger ones STRIP rows at a time.
_SMALL, _PAIRS, _STRIP = 64, 1 << 15, 256


def parameters(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n classes."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 2))))
    p = 1 - math.acos(threshold) / math.pi
    return min(bits, 62), math.ceil(math.log(miss) / math.log1p(-(p ** min(bits, 62))))


def _checked(vectors: DataFrame) -> DataFrame:
    """vec_id, digest and bytes of each vector; both null where it takes no part."""
    kind = vectors.schema["embedding"].dataType
    as_type = np.dtype("<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8")
    schema = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, kept = [], []
            for i, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = None
                if i is not None and held.is_valid and not held.values.null_count:
                    v = held.values.to_numpy(zero_copy_only=False).astype(as_type) + as_type.type(0)  # no negative zeros
                    v = v if len(v) and np.isfinite(v).all() and v.any() else None
                kept.append(None if v is None else v.tobytes())
                digests.append(None if v is None else hashlib.md5(kept[-1], usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if as_type.itemsize == 4 else "array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, digest binary, vector binary")


def _matrix(rows: list[bytes], wide: int) -> np.ndarray:
    """Vectors of one length as doubles, each scaled by a power of two so that no product overflows."""
    m = np.frombuffer(b"".join(rows), f"<f{wide}").reshape(len(rows), -1).astype(np.float64)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def _keyed(classes: DataFrame, wide: int, bits: int, tables: int) -> DataFrame:
    """rep, n, dim, vector, keys (one a table), packed (the keys as bytes)."""
    narrow = np.dtype("<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8")
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("keys", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            held = batch.column(2).to_pylist()
            dims = np.array([len(v) // wide for v in held])
            keys = np.zeros((len(held), tables), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((tables, bits, d))
                m = _matrix([held[i] for i in at], wide)
                for t in range(tables):
                    keys[at, t] = (m @ planes[d][t].T > 0) @ weights
            packed = keys.astype(narrow)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), batch.column(2), pa.array(list(keys), pa.list_(pa.int64())), pa.array([k.tobytes() for k in packed], pa.binary())], schema=schema
            )

    return classes.select("rep", "n", "vector").mapInArrow(run, "rep long, n long, dim int, vector binary, keys array<long>, packed binary")


class _Rows:
    """Rows of complete cells, as arrays."""

    def __init__(self, rows: pa.Table, wide: int, bits: int, threshold: float):
        whole = {c: rows.column(c).combine_chunks() for c in ("table", "key", "low", "high", "block", "rep", "n")}
        self.table, self.key, self.low, self.high, self.block, self.rep, self.n = (whole[c].to_numpy() for c in whole)
        self.vectors = _matrix(rows.column("vector").to_pylist(), wide)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        narrow = "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"
        self.keys = np.frombuffer(b"".join(rows.column("packed").to_pylist()), narrow).reshape(len(self.rep), -1)
        self.threshold = threshold
        self.nodes, self.of = np.unique(self.rep, return_inverse=True)
        self.links, self.parent = np.zeros(len(self.nodes), np.int64), np.arange(len(self.nodes))

    def _take(self, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs at the threshold, less those of two blocks' own, of one id and of earlier tables."""
        keep = ((self.low[x] == self.high[x]) | (self.block[x] != self.block[y])) & (self.rep[x] != self.rep[y])
        x, y = x[keep], y[keep]
        for t in range(int(self.table[x].max()) if len(x) else 0):
            keep = (self.keys[x, t] != self.keys[y, t]) | (self.table[x] <= t)
            x, y = x[keep], y[keep]
            if not len(x):
                return
        a, b = self.of[x], self.of[y]
        np.add.at(self.links, a, self.n[y])
        np.add.at(self.links, b, self.n[x])
        while True:  # roots hook to the least root they meet
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.parent, up := self.parent[self.parent]):
                self.parent = up

    def compare(self) -> None:
        edge = np.flatnonzero(np.append(True, (np.diff(self.table) != 0) | (np.diff(self.key) != 0) | (np.diff(self.low) != 0) | (np.diff(self.high) != 0)))
        sizes = np.diff(np.append(edge, len(self.rep)))
        for s in np.unique(sizes[(sizes > 1) & (sizes <= _SMALL)]).tolist():
            i, j = np.triu_indices(s, 1)
            starts = edge[sizes == s]
            step = max(1, _PAIRS // len(i))
            for k in range(0, len(starts), step):
                x, y = ((starts[k : k + step, None] + p).ravel() for p in (i, j))
                cosine = np.einsum("ij,ij->i", self.vectors[x], self.vectors[y]) / (self.norms[x] * self.norms[y])
                near = cosine >= self.threshold
                self._take(x[near], y[near])
        for a, s in zip(edge[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
            for k in range(a, a + s, _STRIP):
                own = slice(k, min(k + _STRIP, a + s))
                cosine = self.vectors[own] @ self.vectors[k : a + s].T
                cosine /= self.norms[own, None] * self.norms[None, k : a + s]
                x, y = np.nonzero(cosine >= self.threshold)
                later = x < y
                self._take(x[later] + k, y[later] + k)


def _links(cells: DataFrame, wide: int, bits: int, threshold: float) -> DataFrame:
    """rep, links, root: links of each class found in some cells, and a class it is connected with there. cells come sorted."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    group = ("dim", "table", "key", "low", "high")

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = rows.column("dim").to_numpy()
        for a, b in zip(cuts := np.flatnonzero(np.append(True, np.diff(dims) != 0)), np.append(cuts[1:], len(dims)), strict=True):
            own = _Rows(rows.slice(a, b - a), wide, bits, threshold)
            own.compare()
            some = np.flatnonzero(own.links)
            yield pa.RecordBatch.from_arrays([pa.array(own.nodes[some]), pa.array(own.links[some]), pa.array(own.nodes[own.parent[some]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last cell, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in group]
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(group, last, strict=True):
                same &= batch.column(c).to_numpy() == v
            start = batch.num_rows - int(same.sum())
            if start or rest and [rest[-1].column(c)[-1].as_py() for c in group] != last:
                whole = pa.Table.from_batches([*rest, batch.slice(0, start)])
                rest = []
                if whole.num_rows:
                    yield from found(whole)
            rest.append(batch.slice(start))
        if rest:
            yield from found(pa.Table.from_batches(rest))

    return cells.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding)."""
    keep = Scratch(spark)
    rows = _checked(vectors)
    kind = vectors.schema["embedding"].dataType
    wide = 4 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else 8
    rows = keep.save(rows, "rows")
    classes = keep.save(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "classes")
    bits, tables = parameters(classes.count(), threshold, miss)
    keyed = keep.save(_keyed(classes, wide, bits, tables), "keyed")

    postings = keyed.select("rep", "dim", F.posexplode("keys").alias("table", "key"))
    buckets = postings.groupBy("dim", "table", "key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = keep.save(buckets.select("dim", "table", "key", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "buckets")
    shared = postings.join(buckets, ["dim", "table", "key"]).groupBy("rep").agg(F.collect_set(F.struct("dim", "table", "key", "blocks")).alias("held"))
    shared = keep.save(shared, "shared")
    sent = keyed.join(shared, "rep").withColumn("h", F.explode("held")).where("h.dim = dim AND keys[h.table] = h.key")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    sent = sent.select("rep", "n", "dim", "vector", "packed", "h.table", "h.key", "h.blocks").withColumn("block", own)
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    cells = sent.withColumn("c", F.explode(sides)).select("dim", "table", "key", "c.low", "c.high", "block", "rep", "n", "vector", "packed")
    group = ["dim", "table", "key", "low", "high"]
    found = keep.save(_links(cells.repartition(*group).sortWithinPartitions(*group), wide, bits, threshold), "found")
    keep.drop("shared", "buckets", "keyed")

    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b"), keep, "near")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("digest", "rep", "n").join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    named = keep.save(named.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("label", "rep").alias("component")), "named")
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).cast("long")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))


#: All pairs, so for small tables only.
ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
l AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
FROM v LEFT JOIN l ON l.a = vec_id LEFT JOIN c ON c.a = vec_id"""
