"""The stored lexical index against the plain search: equal results, fewer postings read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.operators import lexical, lexical_index


def corpus(spark, seed, n=400):
    """Words of falling frequency, repeated and empty texts, texts without letters."""
    rng = np.random.default_rng(seed)
    names = ["".join(chr(97 + x) for x in rng.integers(0, 26, 4)) + s for s in ("", "é", "ß") for _ in range(120)]
    p = 1 / np.arange(1, len(names) + 1)
    texts = [" ".join(rng.choice(names, rng.integers(1, 60), p=p / p.sum())) for _ in range(n)]
    texts += [texts[3], texts[3].upper(), "", None, "12 34", names[-1], " ".join(names)]
    docs = [(k * 7 % 10_007, t) for k, t in enumerate(texts)] + [(None, texts[5])]
    queries = [(k, " ".join(rng.choice(names, rng.integers(1, 12)))) for k in range(40)] + [(90, texts[3]), (91, "unheard"), (92, ""), (93, None), (94, names[0])]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


@pytest.mark.parametrize("seed,block,lead,group,shard,few", [(1, 4, 1, 16, 50, 0), (2, 1, 2, 8192, 2048, 10**6), (3, 64, 2, 5, 7, 0)])
def test_equals_the_plain_search(spark, tmp_path, monkeypatch, seed, block, lead, group, shard, few):
    monkeypatch.setattr(lexical_index, "FEW", few)  # both ways to the last sums
    docs, queries = corpus(spark, seed)
    lexical_index.write_index(docs, f"{tmp_path}/ix", block, lead, group, shard)
    index = lexical_index.read_index(spark, f"{tmp_path}/ix")
    plain = docs.where("doc_id IS NOT NULL")
    for k in (1, 5, 300):
        want = rows(lexical.search(queries, plain, k))
        assert rows(lexical_index.search(queries, index, k)) == want
    sizes = index.blocks.agg(F.max(F.size("docs")).alias("m")).first()
    assert sizes.m <= block
    # each posting is in one block, in falling order
    held = index.blocks.select("term", F.explode(F.arrays_zip("docs", "weights")).alias("p"))
    assert held.count() == held.select("term", "p.docs").distinct().count() == index.lexicon.agg(F.sum("df")).first()[0]
    assert index.blocks.where("weights <> sort_array(weights, false) OR most <> weights[0]").isEmpty()


def test_reads_fewer_postings_than_it_holds(spark, tmp_path, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{sf001}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    lexical_index.write_index(docs, f"{tmp_path}/ix", block=8)
    index = lexical_index.read_index(spark, f"{tmp_path}/ix")
    q = lexical_index.query_terms(queries, index).cache()
    held = q.join(index.blocks, "term").agg(F.sum(F.size("docs"))).first()[0]
    lead = lexical_index.leading(q, index)
    reach = lexical_index._kth(lexical_index._sums(lead), 10)
    read = lexical_index.needed(lexical_index.bounded(q, reach), index).agg(F.sum(F.size("docs"))).first()[0]
    assert lead.agg(F.sum(F.size("docs"))).first()[0] < held and read < 0.7 * held


def test_unfinished_index_is_refused(spark, tmp_path):
    docs, _ = corpus(spark, 4, 5)
    path = f"{tmp_path}/ix"
    lexical_index.write_index(docs, path)
    with pytest.raises(FileExistsError):
        lexical_index.write_index(docs, path)
    (tmp_path / "ix" / "meta" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        lexical_index.read_index(spark, path)


def test_empty_corpus(spark, tmp_path):
    docs, queries = corpus(spark, 5, 5)
    lexical_index.write_index(docs.where("false"), f"{tmp_path}/ix")
    assert rows(lexical_index.search(queries, lexical_index.read_index(spark, f"{tmp_path}/ix"))) == []


def test_common_words_make_no_rows_of_pairs(spark, tmp_path, monkeypatch):
    """Queries of common words: what leaves a shard is k a query at most, whatever the number of documents that hold the words."""
    rng = np.random.default_rng(9)
    names = [chr(97 + i) * 3 for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(names, 12))) for i in range(600)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choice(names, 6))) for i in range(30)], "query_id long, text string")
    lexical_index.write_index(docs, f"{tmp_path}/ix", group=7, shard_docs=100)
    index = lexical_index.read_index(spark, f"{tmp_path}/ix")
    monkeypatch.setattr(lexical_index, "PAIRS", 50)
    for dense in (lexical_index.DENSE, 2.0):  # by matrix, and by adding up
        monkeypatch.setattr(lexical_index, "DENSE", dense)
        assert rows(lexical_index.search(queries, index, 3)) == rows(lexical.search(queries, docs, 3))
    q = lexical_index.query_terms(queries, index)
    shards = index.blocks.select("shard").distinct().count()
    assert shards >= 6 and lexical_index.by_shard(q, index, 3).count() <= 3 * 30 * shards
