"""Lexical channel: TF-IDF cosine as a sparse join on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERM = r"\p{L}+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def weights(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, w) and (term, idf) of docs (doc_id, text): raw counts times smooth idf, before the norm."""
    tf = docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row
    return tf.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w")), idf


def norms(w: DataFrame) -> DataFrame:
    return w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, weight) with weights of unit norm, and (term, idf): the tables to keep for repeated searches."""
    raw, idf = weights(docs)
    return raw.join(norms(raw), "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight")), idf


def search(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank, channel): the k most similar documents; scores of 6 digits, ties to the higher id.

    Only postings of the queries' terms are joined; norms are one row a document.
    """
    raw, idf = weights(docs)
    tf = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    q = tf.join(idf, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("qw"))
    query_norms = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dot = q.join(raw, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    scored = dot.join(query_norms, "query_id").join(norms(raw), "doc_id")
    scored = scored.select("query_id", F.col("doc_id").alias("chunk_id"), F.round(F.col("dot") / (F.col("qn") * F.col("norm")), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("channel", F.lit("tfidf"))
