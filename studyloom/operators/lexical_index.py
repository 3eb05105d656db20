"""A stored TF-IDF index: postings in blocks with their greatest weight, and a search that reads only blocks that can matter.

Tables of an index, under one folder:

- ``lexicon``: term, df, idf, top (the term's greatest weight), cut (the greatest weight of its ``LEAD``-th best block), n_blocks;
- ``blocks``: shard, term, most, weights, docs: up to ``BLOCK`` postings of a term in a shard of documents, in falling order of weight;
- ``meta``: number of documents, written last, so that a folder without it is no index.

Building counts terms in shards of documents (a task's batch), so that a term makes one row a shard and not one for each
document. The corpus' idf comes back to each shard as one row for each of its terms, weights are normed there and cut into
blocks there: postings are shuffled once, as numbers, and no term is gathered whole.

A search is a batch of queries and is exact. With u a term's weight in the query and top its greatest weight in a document:
1. partial sums over each term's leading blocks give every query a score that its k-th best document reaches at least;
2. terms whose greatest contributions together stay below that can't make a result and aren't read (MaxScore); of the other
   terms a block is read only if its best posting could reach the score with all other terms at their greatest;
3. documents found so whose bound reaches the score, raised by what was read, tell the shards that matter to a query;
4. a shard's blocks meet the queries that it matters to in one task, which sums all their terms in a table of queries by documents:
   what goes on is k a shard and query at most, and pairs are no rows.
Where the terms to be read have many postings, as for queries of common words, pairs of queries and documents would be more than
the index itself. There steps 2 and 3 are left out, and all shards matter.

Cases: null text and text without letters has no terms and is never found; a null doc_id takes no part; documents with equal
rounded scores are ranked by the higher id; queries without known terms have no rows. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.files import exists
from ..sources.scratch import dropped, written
from .lexical import terms

#: Postings of a block; blocks of a term whose sums give the first threshold; queries that meet a shard together, about; documents of a shard.
BLOCK, LEAD, GROUP, SHARD = 64, 2, 1024, 5000
#: Up to so many pairs of queries and postings a document are read as rows to find the shards that matter; otherwise all do. Both give the same sums.
FEW = 2
#: Leading blocks of a term that are read at most.
MOST_LEADING = 8
#: A term that so many documents of a shard share is summed as a row of a matrix; pairs that are summed at a time otherwise; terms of a matrix.
DENSE, PAIRS, ROWS = 1 / 16, 1 << 21, 256
#: Scores have 6 digits: a bound is out only if it stays below by more than rounding can add.
MARGIN = 2e-6


class Index(NamedTuple):
    lexicon: DataFrame
    blocks: DataFrame
    n_docs: int
    n_group: int = GROUP


def _counted(docs: DataFrame, shard_docs: int) -> DataFrame:
    """A row a shard with its documents and their counts, (place of the document, code of the term, tf), and a row for each of its terms."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, shard_docs):
                batch = whole.slice(at, shard_docs)
                ids, lists = batch.column(0), batch.column(1)
                flat = lists.flatten().dictionary_encode()
                names, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(names):
                    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    key, tf = np.unique(np.repeat(np.arange(len(ids)), length) * len(names) + code, return_counts=True)
                    doc, code = (key // len(names)).astype(np.int32), (key % len(names)).astype(np.int32)
                    df = np.bincount(code, minlength=len(names))
                    kinds = {"shard": pa.int64(), "code": pa.int32(), "term": pa.string(), "df": pa.int64(), "ids": pa.list_(ids.type), "doc": pa.list_(pa.int32()), "codes": pa.list_(pa.int32()), "tf": pa.list_(pa.int32())}
                    head = {"shard": pa.array([shard]), "ids": pa.array([ids.to_pylist()], kinds["ids"]), "doc": pa.array([doc], kinds["doc"]), "codes": pa.array([code], kinds["codes"]), "tf": pa.array([tf.astype(np.int32)], kinds["tf"])}
                    rest = {"shard": pa.array(np.full(len(names), shard)), "code": pa.array(np.arange(len(names), dtype=np.int32)), "term": names.cast(pa.string()), "df": pa.array(df)}
                    for columns in (head, rest):
                        n = len(columns["shard"])
                        yield pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in kinds.items()], names=list(kinds))
                shard += 1

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("terms"))
    return rows.mapInArrow(run, f"shard long, code int, term string, df long, ids array<{id_type}>, doc array<int>, codes array<int>, tf array<int>")


def _weighted(counted: DataFrame, idf: DataFrame, id_type: str, block: int) -> DataFrame:
    """The blocks: shard, term, most, weights (of unit norm by document, falling), docs."""

    def norm(rows: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(own.column("code").to_numpy())
        names = own.column("term").combine_chunks().take(pa.array(order))
        factor = own.column("idf").to_numpy()[order]
        ids = rows.column("ids").combine_chunks().flatten()
        doc, code, tf = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("doc", "codes", "tf"))
        w = tf * factor[code]
        w /= np.sqrt(np.bincount(doc, w * w, len(ids)))[doc]
        by_term = np.lexsort((-w, code))
        df = np.bincount(code, minlength=len(names))
        of = np.repeat(np.arange(len(names)), -(-df // block))  # the term of each block
        starts = np.cumsum(df) - df
        at = starts[of] + ranges_of(-(-df // block)) * block
        falling, edges = w[by_term], pa.array(np.append(at, len(code)), pa.int32())
        return pa.table({
            "shard": pa.array(np.full(len(of), rows.column("shard")[0].as_py())),
            "term": names.take(pa.array(of)),
            "most": pa.array(falling[at]),
            "weights": pa.ListArray.from_arrays(edges, pa.array(falling)),
            "docs": pa.ListArray.from_arrays(edges, ids.take(pa.array(doc[by_term]))),
        })

    heads = counted.where("term IS NULL").select("shard", "ids", "doc", "codes", "tf")
    known = counted.where("term IS NOT NULL").select("shard", "code", "term").join(idf, "term").select(F.col("shard").alias("in_shard"), "code", "term", "idf")
    return heads.groupBy("shard").cogroup(known.groupBy("in_shard")).applyInArrow(norm, _schema(id_type))


def _schema(id_type: str) -> str:
    return f"shard long, term string, most double, weights array<double>, docs array<{id_type}>"


def ranges_of(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each of sizes, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def write_index(docs: DataFrame, path: str, block: int = BLOCK, lead: int = LEAD, group: int = GROUP, shard_docs: int = SHARD) -> None:
    """Index docs (doc_id, text) under path, which must be new: an index is of a state of the corpus. group: queries that meet a shard together."""
    spark = docs.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    counted = written(_counted(docs, shard_docs))
    n = docs.where("doc_id IS NOT NULL").count()
    df = counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    idf = written(df.select("term", "df", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    _weighted(counted, idf.select("term", "idf"), id_type, block).write.option("compression", "zstd").parquet(f"{path}/blocks")

    # of a term in a shard only so many blocks can be among the leading ones; the greatest comes first
    blocks = spark.read.schema(_schema(id_type)).parquet(f"{path}/blocks").select("shard", "term", "most")
    best = F.slice(F.sort_array(F.collect_list("most"), False), 1, lead)
    own = blocks.groupBy("term", "shard").agg(best.alias("best"), F.count("*").alias("n"))
    whole = own.groupBy("term").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, lead).alias("best"), F.sum("n").alias("n_blocks"))
    tops = whole.select("term", F.col("best")[0].alias("top"), F.element_at("best", -1).alias("cut"), "n_blocks")
    idf.join(tops, "term").select("term", "df", "idf", "top", "cut", "n_blocks").write.parquet(f"{path}/lexicon")
    spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(group).alias("n_group"), F.lit(id_type).alias("id_type")).write.parquet(f"{path}/meta")
    dropped(spark, counted, idf)


def read_index(spark: SparkSession, path: str) -> Index:
    """A complete index; one whose writing was cut short is refused."""
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        raise FileNotFoundError(f"{path} holds no complete index")
    meta = spark.read.parquet(f"{path}/meta").first()
    return Index(spark.read.parquet(f"{path}/lexicon"), spark.read.schema(_schema(meta.id_type)).parquet(f"{path}/blocks"), meta.n_docs, meta.n_group)


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, term, u (weight of unit norm), ub (greatest contribution), cut, df."""
    tf = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    q = tf.join(index.lexicon, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("query_id")))
    return q.withColumn("u", F.col("w") / norm).select("query_id", "term", "u", (F.col("u") * F.col("top")).alias("ub"), "cut", "df")


def _sums(read: DataFrame, *more: Column) -> DataFrame:
    """query_id, doc, known of the blocks read."""
    rows = read.withColumn("p", F.explode(F.arrays_zip("docs", "weights")))
    return rows.groupBy("query_id", F.col("p.docs").alias("doc")).agg(F.sum(F.col("u") * F.col("p.weights")).alias("known"), *more)


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """query_id, reach: the k-th best of each query that has so many."""
    best = sums.withColumn("nr", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("known")))).where(F.col("nr") <= k)
    return best.groupBy("query_id").agg(F.count("*").alias("c"), F.min("known").alias("reach")).where(F.col("c") == k).select("query_id", "reach")


def leading(q: DataFrame, index: Index) -> DataFrame:
    """The blocks that phase 1 reads, by query and term."""
    best = index.blocks.join(index.lexicon.join(q.select("term").distinct(), "term").select("term", "cut"), "term").where("most >= cut").drop("cut")
    # of many blocks that are as good as the last one, as for copies of a document, any will do
    nr = F.row_number().over(W.partitionBy("term").orderBy(F.desc("most")))
    best = best.withColumn("nr", nr).where(F.col("nr") <= MOST_LEADING)
    return q.select("query_id", "term", "u").join(best, "term").select("query_id", "term", "u", "docs", "weights")


def bounded(q: DataFrame, reach: DataFrame) -> DataFrame:
    """q with reach, total (of all greatest contributions), needed (whether the term must be read), left (the most that an unread posting of the term adds)."""
    own = W.partitionBy("query_id")
    so_far = F.sum("ub").over(own.orderBy("ub", "term").rowsBetween(W.unboundedPreceding, 0))
    q = q.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)) - MARGIN)
    q = q.withColumn("total", F.sum("ub").over(own)).withColumn("needed", so_far >= F.col("reach"))
    skipped = F.greatest(F.lit(0.0), F.least(F.col("ub"), F.col("reach") - F.col("total") + F.col("ub")))
    return q.withColumn("left", F.when(F.col("needed"), skipped).otherwise(F.col("ub")))


def needed(q: DataFrame, index: Index) -> DataFrame:
    """The blocks that phase 2 reads."""
    both = q.where("needed").select("query_id", "term", "u", "ub", "reach", "total", "left").join(index.blocks, "term")
    return both.where("u * most + total - ub >= reach").select("query_id", "term", "u", "left", "shard", "docs", "weights")


def by_shard(q: DataFrame, index: Index, k: int, matter: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score: of each shard the k best of each query, from query terms q (query_id, term, u). matter: the (query_id, shard) that count, all unless given.

    Queries are dealt over groups; a group and a shard are a cell, which gets the blocks of the group's terms. Terms that many
    documents of the shard share are rows of a matrix that the queries' weights are multiplied with, other postings are added up.
    """
    query_type, doc_type = (d.simpleString() for d in (q.schema["query_id"].dataType, index.blocks.schema["docs"].dataType.elementType))
    groups = max(1, -(-q.select("query_id").distinct().count() // index.n_group))
    q = written(q.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), "query_id", "term", "u"))
    none = pa.table({"query_id": pa.array([], to_arrow_type(q.schema["query_id"].dataType)), "chunk_id": pa.array([], to_arrow_type(index.blocks.schema["docs"].dataType.elementType)), "score": pa.array([], pa.float64())})
    held = index.blocks.select("shard", "term", "docs", "weights").join(q.select("group", "term").distinct(), "term")
    if matter is None:
        asked = q.join(F.broadcast(index.blocks.select(F.col("shard").alias("in_shard")).distinct()))  # a row a shard
    else:
        asked = q.join(matter.withColumnRenamed("shard", "in_shard"), "query_id")
        held = held.join(asked.select("group", F.col("in_shard").alias("shard")).distinct(), ["group", "shard"], "left_semi")
    asked = asked.withColumnRenamed("group", "in_group")

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(held) or not len(asked):
            return none
        docs, queries = (t.column(c).combine_chunks() for t, c in ((held, "docs"), (asked, "query_id")))
        sizes = docs.value_lengths().to_numpy().astype(np.int64)
        flat, queries = docs.flatten().dictionary_encode(), queries.dictionary_encode()
        # places in order of falling ids, so that ties go to the higher one
        names = flat.dictionary
        order = pc.sort_indices(names, sort_keys=[("", "descending")]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, weight = place[flat.indices.to_numpy()], held.column("weights").combine_chunks().flatten().to_numpy()
        terms_of = held.column("term").combine_chunks().dictionary_encode()
        at = pc.index_in(asked.column("term").combine_chunks(), terms_of.dictionary)
        some = at.is_valid().to_numpy(zero_copy_only=False)
        at, who, u = at.drop_null().to_numpy().astype(np.int64), queries.indices.to_numpy()[some].astype(np.int64), asked.column("u").to_numpy()[some]
        n_terms, n_docs, n_queries = len(terms_of.dictionary), len(names), len(queries.dictionary)
        term = np.repeat(terms_of.indices.to_numpy().astype(np.int64), sizes)
        df = np.bincount(term, minlength=n_terms)
        sums = np.zeros((n_queries, n_docs))

        common = np.flatnonzero(df >= max(1, n_docs * DENSE))
        for first in range(0, len(common), ROWS):
            row = np.full(n_terms, -1)
            row[common[first : first + ROWS]] = np.arange(len(common[first : first + ROWS]))
            own, mine = row[term] >= 0, row[at] >= 0
            table, by = np.zeros((int(row.max()) + 1, n_docs)), np.zeros((n_queries, int(row.max()) + 1))
            np.add.at(table, (row[term[own]], doc[own]), weight[own])
            by[who[mine], row[at[mine]]] = u[mine]
            sums += by @ table

        rare = np.ones(n_terms, bool)
        rare[common] = False
        own, mine = np.flatnonzero(rare[term]), np.flatnonzero(rare[at])
        own = own[np.argsort(term[own], kind="stable")]
        starts = np.searchsorted(term[own], np.arange(n_terms))
        times = df[at[mine]]
        flat_sums, ends = sums.ravel(), np.cumsum(times)
        while len(mine):
            n = max(1, int(np.searchsorted(ends, PAIRS, "right")))
            place_of = own[np.repeat(starts[at[mine[:n]]], times[:n]) + ranges_of(times[:n])]
            np.add.at(flat_sums, np.repeat(who[mine[:n]], times[:n]) * n_docs + doc[place_of], np.repeat(u[mine[:n]], times[:n]) * weight[place_of])
            mine, times = mine[n:], times[n:]
            ends = np.cumsum(times)

        score = np.round(sums, 6)
        found: tuple[list, list, list] = [], [], []
        for i, own_score in enumerate(score):
            over = np.flatnonzero(own_score > 0)
            if len(over) > k:
                over = over[own_score[over] >= np.partition(own_score[over], len(over) - k)[len(over) - k]]
            top = over[np.argsort(-own_score[over], kind="stable")[:k]]
            found[0].append(np.full(len(top), i))
            found[1].append(order[top])
            found[2].append(own_score[top])
        i, d, x = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
        return pa.table({"query_id": queries.dictionary.take(pa.array(i)), "chunk_id": names.take(pa.array(d)), "score": pa.array(x, pa.float64())})

    return held.groupBy("group", "shard").cogroup(asked.groupBy("in_group", "in_shard")).applyInArrow(best, f"query_id {query_type}, chunk_id {doc_type}, score double")


def search(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank, channel): the k most similar documents, as operators.lexical.search gives them."""
    q = written(query_terms(queries, index))
    q = written(bounded(q, _kth(_sums(leading(q, index)), k)))
    pairs = q.where("needed").agg(F.sum("df")).first()[0] or 0
    matter = _shards(q, index, k) if pairs <= FEW * max(1, index.n_docs) else None
    scored = by_shard(q, index, k, matter)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_id")))
    return scored.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).withColumn("channel", F.lit("tfidf"))


def _shards(q: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, shard: the shards of documents that could be among the k best, for queries that have few postings to be read."""
    sums = written(_sums(needed(q, index), F.sum("left").alias("seen"), F.max("shard").alias("shard")))
    rest = q.groupBy("query_id").agg(F.sum("left").alias("rest"), F.max("reach").alias("reach"))
    higher = _kth(sums, k).select("query_id", (F.col("reach") - MARGIN).alias("higher"))
    open_ = sums.join(rest, "query_id").join(higher, "query_id", "left").where("known + rest - seen >= greatest(reach, higher)")
    return written(open_.select("query_id", "shard").distinct())
