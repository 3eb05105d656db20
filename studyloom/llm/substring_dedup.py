"""Substring dedup by hashing lines and their parts.

The units of a text are its lines. A passage that was pasted into the middle of a line would hide
in a unit with its neighbours, so lines of more than ``LONG`` words are cut into parts where the
hash of two adjoining words is the least within ``REACH`` words to either side. Such places depend
on the words around them only, and parts have more than ``REACH`` words, but at a line's ends.
Parts that stay longer than twice ``LONG`` words (loops of a few words) are cut every ``LONG`` words.
Units are normalised: ASCII capitals, white space and punctuation don't count.

Units are grouped by a 128-bit digest over the whole corpus. The occurrence of the smallest
(doc_id, start) is the earliest ranked and stays. All others are marked; neighbouring marked
units of a document become one span, and spans of ``LEAST_WORDS`` words or more are removed.
Of shorter ones the whole lines are, if they have ``LINE_WORDS`` words or ``LINE_CHARS`` characters together
(scripts without spaces have few words); parts of lines and shorter lines stay, as they repeat by chance. Spans have the start and end
(code points, end exclusive) in the original text.

Digests are counted before each shuffle; only occurrences of repeated digests are joined back,
and adaptive execution splits a digest that very many documents hold.

Cases: null or empty text has no units; rows with null doc_id take no part; rows that share a
doc_id count as one document, where equal occurrences (same place, same digest) are one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read
from .hashing import ALNUM, LOWER, groups, mix, word_hashes, words

LONG, REACH, LEAST_WORDS = 10, 3, 15
LINE_WORDS, LINE_CHARS = 6, 40
UNIT = pa.schema([("doc_id", pa.int64()), ("nr", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text nr, start byte, end byte, size, digest 1, digest 2) of the units of newline-ended texts; size: words * 4, + 2 for a line's first unit, + 1 for its last."""
    s, e = words(data, ALNUM)
    if not len(s):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    h = word_hashes(LOWER[data], s, e)
    line = np.concatenate([[0], np.cumsum(data == 0x0A)])[s]
    ends = np.append(line[1:] != line[:-1], True)
    length = np.diff(np.append(-1, np.flatnonzero(ends)))
    cut = np.repeat(length > LONG, length)
    # a line's last word has no word after it, whatever text comes next in the batch
    pair = mix(h * np.uint64(3) + np.append(np.where(line[1:] == line[:-1], h[1:], np.uint64(0)), np.uint64(0)))
    for k in range(1, REACH + 1):
        less, same = pair[:-k] < pair[k:], line[:-k] == line[k:]
        cut[:-k] &= less | ~same
        cut[k:] &= (pair[k:] < pair[:-k]) | ~same
    ends |= cut
    # loops of a few words have no least place; they look alike wherever they are cut
    length = np.diff(np.append(-1, np.flatnonzero(ends)))
    since = np.arange(len(s)) - np.repeat(np.cumsum(length) - length, length)
    ends |= (np.repeat(length, length) > 2 * LONG) & (since % LONG == LONG - 1)
    last = np.flatnonzero(ends)
    first = np.append(0, last[:-1] + 1)
    n = last - first + 1
    place = np.arange(len(s)) - np.repeat(first, n)  # of a word in its unit
    d1 = np.add.reduceat(mix(h + mix(place.astype(np.uint64))), first)
    d2 = np.add.reduceat(mix(h ^ mix(place.astype(np.uint64) + np.uint64(1 << 40))), first)
    text = np.searchsorted(offsets, s[first], side="right") - 1
    # a unit reaches up to the next one in its line, so that spans hold punctuation and space between
    begins, closes = np.append(True, line[last[:-1]] != line[first[1:]]), np.append(line[last[:-1]] != line[first[1:]], True)
    return text, s[first], e[last], n * 4 + begins * 2 + closes, mix(d1 + n.astype(np.uint64)), mix(d2)


def units(docs: DataFrame) -> DataFrame:
    """Units of each row with doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for first, _, data, offsets in groups(texts):
                text, start, end, n, d1, d2 = units_of(data, offsets)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                base = chars[offsets[text]]
                nr = np.arange(len(text)) - np.searchsorted(text, text, side="left")
                columns = [ids[first + text], nr.astype(np.int32), (chars[start] - base).astype(np.int32), (chars[end] - base).astype(np.int32), n.astype(np.int32), d1.view(np.int64), d2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=UNIT)

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, nr int, start int, end int, size int, d1 long, d2 long")


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, n_units, first_doc_id: the spans to remove; first_doc_id is the smallest that holds one of the span's units."""
    keep = Scratch(spark)
    found = keep.save(units(docs), "units")
    earliest = F.min(F.struct("doc_id", "start"))
    again = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1").drop("n")
    again = keep.save(again, "again")
    marked = keep.save(found.join(again, ["d1", "d2"]), "repeated")
    keep.drop("units")
    # inside the earliest document its first occurrence stays
    inside = marked.where("doc_id = first_doc_id").groupBy("d1", "d2").agg(earliest.alias("e")).select("d1", "d2", F.col("e.start").alias("keep_start"))
    inside = keep.save(inside, "inside")  # a plain table on this side lets the join split a digest that very many hold
    marked = marked.join(inside, ["d1", "d2"]).where("doc_id <> first_doc_id OR start <> keep_start")
    # dealt by document before the rest, for the same reason
    marked = marked.repartition("doc_id").dropDuplicates(["doc_id", "nr", "start", "d1", "d2"])
    order = W.partitionBy("doc_id").orderBy("nr")
    run = F.sum((F.col("nr") - F.coalesce(F.lag("nr").over(order), F.lit(-2)) > 1).cast("int")).over(order)
    of_run = W.partitionBy("doc_id", "run")
    marked = marked.withColumn("run", run).withColumn("n_words", F.shiftright("size", 2))
    marked = marked.withColumn("enough", F.sum("n_words").over(of_run) >= LEAST_WORDS)
    # only a run's first and last line can be parts
    begin, close = F.min(F.when(F.col("size").bitwiseAND(2) > 0, F.col("nr"))).over(of_run), F.max(F.when(F.col("size").bitwiseAND(1) > 0, F.col("nr"))).over(of_run)
    marked = marked.withColumn("begin", begin).withColumn("close", close).where("enough OR nr BETWEEN begin AND close")
    spans = marked.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_units"), F.min("first_doc_id").alias("first_doc_id")
    )
    return spans.where((F.col("n_words") >= LINE_WORDS) | (F.col("end") - F.col("start") >= LINE_CHARS)).drop("run")


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans in text; removed (which replaces a column of that name): array of (start, end) in the original text."""
    gone = spans.groupBy(F.col("doc_id").alias("__doc")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__gone"))
    joined = docs.join(gone, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    n = F.size("__gone")

    def piece(i: Column) -> Column:
        begin = F.coalesce(F.get("__gone", i - 1)["end"], F.lit(0))
        end = F.coalesce(F.get("__gone", i)["start"], F.length("text"))
        return F.substring("text", begin + 1, end - begin)

    text = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")).otherwise(F.col("text"))
    return joined.withColumn("text", text).withColumn("removed", F.col("__gone")).drop("__gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
