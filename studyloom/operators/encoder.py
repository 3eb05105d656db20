"""A text encoder fitted on the corpus: hashed TF-IDF features under a random projection.

Terms are hashed to ``FEATURES`` features, each weighs (1 + ln tf) * idf with the corpus' idf, and every feature has a fixed random direction of
signs; a text's vector is the weighted sum of its features' directions, of unit norm. So the cosine of two vectors estimates that of the
TF-IDF vectors, with an error of about 1 / sqrt(dimension) (Johnson-Lindenstrauss). What is fitted is the table of idf, one row a
feature at most, so its size is bounded whatever the corpus holds. Vectors are ready for operators.vector_index.

Cases: null text and text without terms gives the zero vector; features that the corpus lacks weigh as those of no document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import terms

FEATURES, DIMENSION, SEED = 1 << 16, 256, 11


class Encoder(NamedTuple):
    """n_docs and the features' document frequencies."""

    n_docs: int
    df: np.ndarray
    dimension: int = DIMENSION


def features(text: Column) -> Column:
    """The features of a text, with repeats."""
    return F.transform(terms(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES)).cast("int"))


def fit(docs: DataFrame, dimension: int = DIMENSION) -> Encoder:
    """The encoder of docs (text)."""
    rows = docs.select(F.explode(F.array_distinct(features(F.col("text")))).alias("feature"))
    found = rows.groupBy("feature").agg(F.count("*").alias("df")).toArrow()  # at most FEATURES rows
    df = np.zeros(FEATURES, np.int64)
    df[found.column("feature").to_numpy()] = found.column("df").to_numpy()
    return Encoder(docs.count(), df, dimension)


def save(encoder: Encoder, spark: SparkSession, path: str) -> None:
    some = np.flatnonzero(encoder.df)
    rows = [(int(f), int(encoder.df[f])) for f in some] + [(-1, encoder.n_docs), (-2, encoder.dimension)]
    spark.createDataFrame(rows, "feature int, df long").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Encoder:
    held = {r.feature: r.df for r in spark.read.parquet(path).collect()}
    df = np.zeros(FEATURES, np.int64)
    own = [f for f in held if f >= 0]
    df[own] = [held[f] for f in own]
    return Encoder(held[-1], df, held[-2])


def _directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (FEATURES, dimension), dtype=np.int8) * np.int8(2) - np.int8(1)


_known: dict[int, np.ndarray] = {}


def encode(df: DataFrame, encoder: Encoder, key: str, text: str = "text", prefix: str = "") -> DataFrame:
    """key and vector (array<float>) of prefix + text."""
    idf = np.log((1 + encoder.n_docs) / (1 + encoder.df)) + 1
    width = encoder.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if width not in _known:
            _known[width] = _directions(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(1)
                length = lists.value_lengths().to_numpy()
                key_of, tf = np.unique(np.repeat(np.arange(len(length)), length) * FEATURES + lists.flatten().to_numpy(), return_counts=True)
                row, feature = key_of // FEATURES, key_of % FEATURES
                weight = (1 + np.log(tf)) * idf[feature]
                out = np.zeros((len(length), width))
                starts = np.searchsorted(row, np.arange(len(length) + 1))
                for i in np.flatnonzero(np.diff(starts)).tolist():
                    a, b = starts[i], starts[i + 1]
                    out[i] = weight[a:b] @ _known[width][feature[a:b]]
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out = (out / np.where(norm > 0, norm, 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float32()))], names=[key, "vector"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, features(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))).alias("__features")).mapInArrow(run, f"`{key}` {kind}, vector array<float>")
