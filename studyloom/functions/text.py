"""Text expressions. All are JVM-side columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def or_else(c: Column, default: object) -> Column:
    """Default for null."""
    return F.coalesce(c, F.lit(default))


def falsy_or(c: Column, other: Column) -> Column:
    """The other value where the text is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def bigrams(c: Column) -> Column:
    """Two-character pieces at all positions, with repeats; empty under two characters."""
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))


def fuzzy_contains(text: Column, target: Column) -> Column:
    """Whether the text holds the target (of 3 characters or more), or 3 in 5 of its two-character pieces (of 4 or more).

    The share is of the target's length, not of its pieces. Null or empty sides give false. For many rows against many
    targets use fuzzy_pairs.
    """
    n = F.length(target)
    near = F.size(F.filter(bigrams(target), lambda g: F.contains(text, g))) * 5 >= n * 3
    found = ((n >= 3) & F.contains(text, target)) | ((n >= 4) & (F.length(text) > 0) & near)
    return F.coalesce(found, F.lit(False))


#: Queries and targets of a cell of fuzzy_holders, about: both are dealt by hash.
CELL_QUERIES, CELL_TARGETS = 2048, 1 << 14


def fuzzy_holders(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, batch, ids): the queries whose text fuzzily contains target, a row for each batch of queries that has any: texts (query_id, text), targets (target).

    Queries are dealt over batches and targets over parts, by hashes, so a query is in one batch whatever is computed twice; each pair
    of them is a cell of bounded size. In a cell the queries' two-character pieces are the rows of a table of bytes, a column a
    query; a target's rows are added up, and who has enough is read off. Pieces of a target count as often as it holds them, those
    of a text once. From 4 characters on a contained target has all its pieces in the text, so the substring rule is for 3 characters only.
    """
    spark = texts.sparkSession
    targets = written(targets.select("target").where("length(target) >= 3").distinct())
    texts = texts.select("query_id", "text").where("length(text) > 0")
    batches, parts = max(1, -(-texts.count() // CELL_QUERIES)), max(spark.sparkContext.defaultParallelism, -(-targets.count() // CELL_TARGETS))

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = texts.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int")).withColumn("part", spread(parts))
    held = targets.withColumn("in_part", F.pmod(F.xxhash64("target"), F.lit(parts)).cast("int")).withColumn("in_batch", spread(batches))
    id_type = texts.schema["query_id"].dataType.simpleString()

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, found = asked.column("query_id").combine_chunks(), ([], [])
        own = asked.column("text").to_pylist()
        number: dict[str, int] = {}
        pairs = {(number.setdefault(t[i : i + 2], len(number)), q) for q, t in enumerate(own) for i in range(len(t) - 1)}
        has = np.zeros((len(number) + 1, len(own)), np.uint8)  # the last row is of pieces that no query has
        if pairs:
            has[tuple(np.array(list(pairs)).T)] = 1
        for t in held.column("target").to_pylist():
            if len(t) == 3:
                hit = np.array([t in x for x in own], bool)
            else:
                rows = has[[number.get(t[i : i + 2], -1) for i in range(len(t) - 1)]]
                hit = rows.sum(axis=0, dtype=np.uint32) * 5 >= 3 * len(t)
            if hit.any():
                found[0].append(t)
                found[1].append(np.flatnonzero(hit))
        lengths = np.append(0, np.cumsum([len(x) for x in found[1]])).astype(np.int32)
        flat = np.concatenate(found[1]) if found[1] else np.zeros(0, np.int64)
        batch = asked.column("batch")[0].as_py() if len(ids) else 0
        return pa.table({"target": pa.array(found[0], pa.string()), "batch": pa.array([batch] * len(found[0]), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(lengths), ids.take(pa.array(flat)))})

    return asked.groupBy("batch", "part").cogroup(held.groupBy("in_batch", "in_part")).applyInArrow(compare, f"target string, batch int, ids array<{id_type}>")


def fuzzy_pairs(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target) where text fuzzily contains target: texts (query_id, text), targets (target)."""
    return fuzzy_holders(texts, targets).select(F.explode("ids").alias("query_id"), "target")


def any_keyword(text: Column, keywords: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k)) if keywords else F.lit(False)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords the text holds; nested keywords count separately."""
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.contains(text, F.lit(k)).cast("int")
    return F.coalesce(hits, F.lit(0))


#: White space as Python's strip takes it, for regular expressions of several engines.
BLANK = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def filled_lines(c: Column) -> Column:
    """The lines that hold more than white space."""
    return F.filter(F.split(c, "\n"), lambda x: F.regexp_replace(x, BLANK, "") != "")


def first_of(a: Column, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(default))


def last_of(a: Column, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(default))


def ordered_text(key: Column, line: Column, separator: str = "\n", descending: bool = False) -> Column:
    """Aggregate: the lines in order of key (then of line), joined."""
    rows = F.sort_array(F.collect_list(F.struct(key.alias("k"), line.alias("x"))), asc=not descending)
    return F.array_join(F.transform(rows, lambda r: r["x"]), separator)


def chosen_phrase(key: Column, phrases: list[str]) -> Column:
    """One of the phrases, by the first seven digits of the key's MD5: reruns agree, and so do other engines."""
    number = F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 7), 16, 10).cast("long")
    return F.get(F.array(*map(F.lit, phrases)), F.pmod(number, F.lit(len(phrases))).cast("int"))
