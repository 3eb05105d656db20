"""Preparation of a corpus: chunking, correction, normalisation, near-duplicate candidates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .components import components


def chunk(docs: DataFrame, lines: int = 4) -> DataFrame:
    """(doc_id, chunk_no, chunk_text): so many lines a chunk."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.select("doc_id", F.transform(split, lambda x: x).alias("ls"))
    groups = F.transform(F.sequence(F.lit(0), F.expr(f"(size(ls) - 1) div {lines}")), lambda i: F.struct(i.alias("chunk_no"), F.array_join(F.slice("ls", i * lines + 1, F.lit(lines)), "\n").alias("chunk_text")))
    return rows.select("doc_id", F.explode(groups).alias("c")).select("doc_id", "c.*")


def corrected(text: Column, pairs: dict[str, str]) -> Column:
    """Known misreadings replaced, in order."""
    for wrong, right in pairs.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def tag(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """(doc_id, tags): the tags one of whose signals (tag, signal) a text holds, in order of name; empty without any.

    The signal table is a short list that is aggregated to one row; documents aren't shuffled.
    """
    listed = signals.groupBy("tag").agg(F.collect_set("signal").alias("words")).agg(F.sort_array(F.collect_list(F.struct("tag", "words"))).alias("table"))
    both = docs.join(F.broadcast(listed))  # one row
    held = F.filter("table", lambda t: F.exists(t["words"], lambda w: F.contains(F.col("text"), w)))
    return both.select("doc_id", F.transform(held, lambda t: t["tag"]).alias("tags"))


def normalized(df: DataFrame, column: str = "text", form: str = "NFKC") -> DataFrame:
    """Unicode normalisation, in Arrow batches: Spark has no such function."""

    def norm(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return df.withColumn(column, F.pandas_udf(norm, "string")(F.col(column)))


def _settled(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder."""
    return written(df)


def _least_hashes(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, class, n, keys): of each of sets (doc_id, class, s) the size and, for each band, the hash of its least hashes. A multiplier and a mix make each of the functions; numpy, in Arrow batches."""
    rng = np.random.default_rng(20)
    times, plus = (rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) for _ in range(2))
    times |= np.uint64(1)
    id_type = sets.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                tokens = batch.column(2)
                length = tokens.value_lengths().to_numpy()
                flat = tokens.flatten().to_numpy().view(np.uint64)
                starts = np.cumsum(length) - length
                keys = np.zeros((len(length), bands), np.uint64)
                for k in range(bands * rows):
                    h = flat * times[k] + plus[k]
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    own = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
                    keys[:, k // rows] = (keys[:, k // rows] ^ own) * np.uint64(0x94D049BB133111EB) + np.uint64(k)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length.astype(np.int32)), lists], names=["doc_id", "class", "n", "keys"])

    return sets.select("doc_id", "class", "s").mapInArrow(run, f"doc_id {id_type}, class long, n int, keys array<long>")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s, class): the sorted hashes of a document's shingles, and a hash of these; none of documents without words."""
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    base = docs.where("doc_id IS NOT NULL").select("doc_id", tokens.alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.size("w") - words + 1, F.lit(1))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("w", i, F.lit(words)))))
    return base.select("doc_id", F.array_sort(shingles).alias("s")).withColumn("class", F.xxhash64("s"))


def minhash_pairs(docs: DataFrame, words: int = 5, bands: int = 24, rows: int = 4, threshold: float = 0.8) -> DataFrame:
    """(doc_a, doc_b, similarity, component_id): near-duplicate links by MinHash bands, and the smallest doc_id that links reach from both.

    Documents of equal shingle sets are one class; its smallest doc_id has a link to each other, with similarity 1. Between classes,
    those that share a bucket are compared: first with two members of the bucket, its smallest and the one of the smallest hash, which
    is linear in its size and joins most of a group of near copies, then all pairs that are still in different components. So links
    inside a component need not all be rows, but components are those of all pairs that share a bucket, and each document that is
    linked with another has a row. similarity is exact, and at least threshold.

    A set takes more bytes than its text, so sets are made twice: once for the bands' hashes, of which a few bytes a document are
    kept, and again for the classes that share a bucket. Pairs whose sizes alone keep them below the threshold need no sets.
    """
    marks = _settled(_least_hashes(_shingle_sets(docs, words), bands, rows))
    classes = _settled(marks.groupBy("class").agg(F.min(F.struct("doc_id", "n", "keys")).alias("m")).select("class", "m.*"))
    copies = marks.select("class", F.col("doc_id").alias("doc_b")).join(classes.select("class", F.col("doc_id").alias("doc_a")), "class")
    copies = copies.where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("similarity")).distinct()

    banded = classes.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    one = F.struct("doc_id", "n")
    buckets = banded.groupBy("band", "key").agg(F.min(one).alias("one"), F.min_by(one, F.struct(F.xxhash64("doc_id"), "doc_id")).alias("two"), F.count("*").alias("members")).where("members > 1")
    banded = _settled(banded.join(buckets, ["band", "key"]))

    # a representative's set again; of another row with its doc_id the class differs
    asked = _settled(classes.select("doc_id", "class").join(banded.select("doc_id").distinct(), "doc_id", "left_semi"))
    sets = _shingle_sets(docs.join(asked, "doc_id", "left_semi"), words).join(asked, ["doc_id", "class"], "left_semi")
    sets = _settled(sets.select("doc_id", "s"))
    a, b = (sets.select(F.col("doc_id").alias(f"doc_{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = common / (F.size("sa") + F.size("sb") - common)

    def ends(links: DataFrame) -> DataFrame:
        return links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))

    def near(x: str, y: str) -> Column:
        """Whether sets of such sizes may reach the threshold."""
        return F.least(x, y) / F.greatest(x, y) >= threshold

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", similarity.alias("similarity"))
        return _settled(both.where(F.col("similarity") >= threshold).withColumn("similarity", F.round("similarity", 6)).distinct())

    star = banded.select("doc_id", "n", F.explode(F.array("one", "two")).alias("pivot")).where("doc_id <> pivot.doc_id").where(near("n", "pivot.n"))
    links = verified(star.select(F.least("doc_id", "pivot.doc_id").alias("doc_a"), F.greatest("doc_id", "pivot.doc_id").alias("doc_b")).distinct())

    parts = components(ends(links)).withColumnRenamed("node", "doc_id")
    open_ = banded.select("band", "key", "doc_id", "n").join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    x, y = (open_.select("band", "key", F.col("doc_id").alias(f"doc_{s}"), F.col("component").alias(f"part_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    left = x.join(y, ["band", "key"]).where("part_a <> part_b AND doc_a < doc_b").where(near("n_a", "n_b")).select("doc_a", "doc_b").distinct()
    links = _settled(links.unionByName(verified(left)).unionByName(copies))
    return links.join(components(ends(links)).select(F.col("node").alias("doc_a"), F.col("component").alias("component_id")), "doc_a").select("doc_a", "doc_b", "similarity", "component_id")
