"""The driver's tables in the roles of the application's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_WORD = r"\p{L}{5,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    words = F.regexp_extract_all(F.lower("text"), F.lit(LONG_WORD), F.lit(0))
    base = docs.select("doc_id", "source", "lang", "text", F.slice(words, 1, 5).alias("w"))
    return base.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("video_id"),
        (F.col("doc_id") % 7 + 1).cast("int").alias("part_no"),
        F.concat("source", F.lit(" "), "lang").alias("video_title"),
        F.col("lang").alias("collection"),
        F.try_element_at("w", F.lit(1)).alias("short_title"),
        F.substring("text", 1, 200).alias("text_preview"),
        F.slice("w", 1, 3).alias("topics"),
        F.slice("w", 4, 2).alias("patterns"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("has_brand_signal"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("has_warning"),
    )


def nodes(chunks: DataFrame) -> DataFrame:
    """Topic nodes of the chunks' topics; a failure's cause and symptom are the least and greatest pattern seen with it."""
    seen = chunks.select(F.explode("topics").alias("node_id"), F.try_element_at("patterns", F.lit(1)).alias("p"))
    made = seen.groupBy("node_id").agg(F.min("p").alias("cause"), F.max("p").alias("symptom"))
    return made.select("node_id", F.array(F.struct(F.coalesce("cause", F.lit("")).alias("cause"), F.coalesce("symptom", F.lit("")).alias("symptom"))).alias("common_failures"))


def patterns(chunks: DataFrame) -> DataFrame:
    seen = chunks.select(F.explode("patterns").alias("pattern_id"), F.try_element_at("topics", F.lit(1)).alias("t"))
    made = seen.groupBy("pattern_id").agg(F.min("t").alias("name"))
    return made.select("pattern_id", F.array(F.struct(F.coalesce("name", F.lit("")).alias("variant_name"))).alias("question_variants"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector whose id is the query's."""
    q = queries(spark, sf_dir).select("query_id")
    return q.join(vectors(spark, sf_dir), F.col("query_id") == F.col("pos")).select("query_id", F.col("embedding").alias("vector"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a graph: prerequisites are k div 2, k div 3 and k - 7, those over 0."""
    p = table(spark, sf_dir, "part")
    before = F.filter(F.expr("array(p_partkey div 2, p_partkey div 3, p_partkey - 7)"), lambda x: x > 0)
    return p.select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("category"), F.col("p_size").cast("string").alias("difficulty"), F.col("p_brand").alias("exam_weight"), before.alias("prerequisites"))


def history_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("query"), F.col("props").alias("diagnosis"),
        F.col("event_type").alias("diagnosis_summary"), F.col("value").alias("cost"), F.col("ts").alias("created_at"),
    )


def history_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a long history; ten customers are one learner, so that learners have enough rows for compaction."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.expr("o_custkey div 10").alias("user_id"), F.concat(F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority")).alias("query"),
        F.col("o_orderpriority").alias("diagnosis_summary"), F.col("o_totalprice").alias("cost"), F.col("o_orderdate").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("grade"), F.concat(F.lit("school "), F.col("c_nationkey").cast("string")).alias("school"), F.col("c_name").alias("name"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with some credit have a profile."""
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 2000")
    return c.select(
        F.col("c_custkey").alias("user_id"), F.array("c_mktsegment").alias("weak_topics"), F.when(F.col("c_acctbal") > 5000, F.array(F.lit("basics"))).alias("mastered_topics"),
        F.when(F.col("c_acctbal") > 4000, F.lit("pass")).alias("learning_goals"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole token numbers from lineitem, dealt over the providers."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("long")
    return li.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("p"), (F.col("l_partkey") % 8 + 1).cast("string")).alias("provider"),
        (n * 100 + 1000).alias("input_tokens"), (F.col("l_partkey") % 10 * 64).alias("cache_hit_tokens"), (F.col("l_suppkey") % 3 * 32).alias("cache_created_tokens"), (n * 7).alias("output_tokens"),
    )
