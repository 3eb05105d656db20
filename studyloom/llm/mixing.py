"""Mixing sources to target weights by systematic sampling.

Sources, in code-point order with null last, weigh 3, 1, 2, repeating, and share 150 % of
all words. A target stops at twice its source's size; the excess is shared by weight among
the rest until none is above. That fixed point is found in closed form: in order of
cap / weight a source is capped while the level that the rest would reach is above its own.

Each document of a source expects target / source_size copies. Documents stand in order of
(size, doc_id); the prefix sum of expected copies plus one offset per source crosses
integer borders, and each crossing emits the document once. As neighbours have alike sizes,
the words taken come near the target. Expected copies are at most 2, so are the copies.

The prefix sums are distributed: rows are range partitioned by (source, size, doc_id), ranked
inside their range, and offset by the counts of earlier ranges (one row per range and source).
A source or size that holds a third of all rows spans several ranges.

Cases: null text has size 0; a null source is a source of its own; repeated rows count each;
rows that agree in doc_id, source and size are interchangeable; an empty table gives no rows;
sources without words have target 0 and their documents take 0 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, read, rows_of

WEIGHTS, CAP, SHARE = (3, 1, 2), 2, (3, 2)  # SHARE: a fraction, of all words
SEED = "mix-1"


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, start (offset in 0..1) of each source in sizes (source, size)."""
    everything = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy((F.col("source_size") / F.col("weight")), "nr")
    num, den = SHARE
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nr", F.row_number().over(everything) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("nr", F.lit(len(WEIGHTS))) + 1).cast("long"))
    )
    over_all = W.partitionBy()
    sources = sources.withColumn("total", F.sum("source_size").over(over_all)).withColumn("weights", F.sum("weight").over(over_all))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    sources = (
        sources.withColumn("left_num", num * F.col("total") - den * CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_den", den * (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("capped", F.col("left_num") * F.col("weight") >= F.col("left_den") * CAP * F.col("source_size"))
    )
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "nr", "left_num", "left_den"))).over(over_all)
    sources = sources.withColumn("level", level)
    target = F.when(F.col("capped"), (CAP * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("level.left_num")).cast("double") / F.col("level.left_den").cast("double")
    )
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("nr").cast("string"))), 1, 4), 16, 10).cast("double") / 65536
    return sources.select("source", "source_size", target.alias("target"), start.alias("start"))


def copies(position: Column, expected: Column, start: Column) -> Column:
    """Integer borders that the prefix sum crosses at this position (from 1)."""
    crossed = F.floor(position * expected + start) - F.floor((position - 1) * expected + start)
    return F.least(crossed, F.lit(CAP)).cast("long")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each document."""
    keep = Scratch(spark)
    sizes = keep.save(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last(), "size", F.col("doc_id").asc_nulls_last())
    ranged = keep.save(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    keep.drop("sizes")
    targets = keep.save(source_targets(ranged), "targets")
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("part", "source").agg(F.count("*").alias("n")).select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        F.col("part").alias("at_part"), offsets["source"].alias("of_source"), "earlier", "source_size", "target", "start"
    )
    inside = W.partitionBy("part", "source").orderBy("size", F.col("doc_id").asc_nulls_last())
    ranked = ranged.withColumn("nr", F.row_number().over(inside))
    ranked = ranked.join(offsets, (F.col("part") == F.col("at_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = copies(F.col("nr") + F.col("earlier"), expected, F.col("start"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (F.col("size") * n).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed documents, a row for each copy, with all their columns whatever their names. A doc_id that several documents of one source and size share is mixed as rows in equal number."""
    key = F.struct("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    plan = mix(spark, docs).where("copies > 0").groupBy(F.struct("doc_id", "source", "size").alias("__key"))
    plan = plan.agg(F.sort_array(F.collect_list("copies")).alias("__copies"))
    nr = F.row_number().over(W.partitionBy("__key").orderBy(F.xxhash64("__text"), "__text"))
    joined = rows_of(docs, key.alias("__key"), F.col("text").alias("__text")).join(plan, "__key").withColumn("__nr", nr)
    joined = joined.withColumn("__n", F.try_element_at("__copies", F.col("__nr"))).where("__n > 0")
    return joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select("__row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][nr % 3 + 1] AS BIGINT) AS weight FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
  CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS size_before, CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weight_before FROM s1
  WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, 3 * total - 4 * size_before AS left_num, 2 * (weights - weight_before) AS left_den FROM s2),
s4 AS (SELECT *, left_num * weight >= left_den * 2 * source_size AS capped FROM s3),
lv AS (SELECT left_num AS num, left_den AS den FROM s4 WHERE NOT capped ORDER BY CAST(source_size AS DOUBLE) / weight, nr LIMIT 1),
s5 AS (SELECT s4.*, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * lv.num AS DOUBLE) / CAST(lv.den AS DOUBLE) END AS target,
  CAST(CAST('0x' || substr(md5('{SEED}:' || nr), 1, 4) AS INTEGER) AS DOUBLE) / 65536 AS start FROM s4 LEFT JOIN lv ON true),
r AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.start, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS i,
  CASE WHEN s5.source_size > 0 THEN s5.target / s5.source_size ELSE 0 END AS rho FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(i * rho + start) - floor((i - 1) * rho + start), 2) AS BIGINT) AS taken FROM r
"""
