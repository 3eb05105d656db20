"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only on a local master without the setting."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="studyloom-")
    return f"file://{_own_dir}"


_roots: list[str] = []


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    """Results may be read lazily, so the tables live as long as the program, or until ``release``."""
    with contextlib.suppress(Exception):  # the JVM may be gone already
        release(_roots)


def made() -> list[str]:
    """The folders of tables that are there now."""
    return list(_roots)


def release(roots: list[str]) -> None:
    """Clear the tables of such folders: of results that have been written elsewhere, so that nothing reads them any more."""
    for root in list(roots):
        _delete(root)
        if root in _roots:
            _roots.remove(root)


class Scratch:
    """Intermediate tables in the shared folder, cleared at the program's end.

    ``save`` cuts lineage by a written table: a lost executor costs a reread, not a
    recomputation. ``drop`` removes tables that later steps no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/studyloom-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[column], F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a key filter: 32 a key or more, within these bounds. The larger one is 2**19 words, some 30 MB as a broadcast table.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25


class KeyFilter(NamedTuple):
    """A bitmap of hashed keys, (__word, __bits) in at most bits / 64 rows, to be broadcast."""

    words: DataFrame
    bits: int


def _slot(key: Column, bits: int) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.shiftright(slot, 6).cast("int"), F.pmod(slot, F.lit(64)).cast("int")


def key_filter(keys: DataFrame, column: str) -> KeyFilter:
    """A filter of the keys of a written table, sized by their number up to MOST_BITS.

    It keeps rows that surely have no partner out of a shuffle. Beyond some million keys it lets more and more pass, and the join decides.
    """
    bits = min(max(1 << (32 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    word, bit = _slot(F.col(column), bits)
    found = keys.select(word.alias("__word"), bit.alias("__bit")).distinct()
    return KeyFilter(found.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")), bits)


def flagged(df: DataFrame, keys: KeyFilter, key: Column) -> DataFrame:
    """df with __may: whether the key may be among the filter's."""
    word, bit = _slot(key, keys.bits)
    joined = df.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(keys.words), "__word", "left")
    return joined.withColumn("__may", F.coalesce(F.expr("(shiftright(__bits, __bit) & 1) = 1"), F.lit(False))).drop("__word", "__bit", "__bits")


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as __row, a struct of all columns, beside the named ones: whatever the other columns are called, they clash with nothing."""
    return docs.select(F.struct("*").alias("__row"), *columns)
