"""The stored vector index against the plain search: equal results, clusters skipped where vectors have clusters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.operators import vector, vector_index


def data(spark, seed, clustered, n=1500, wide=16):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, wide))
    if clustered:
        m = rng.standard_normal((12, wide))[rng.integers(0, 12, n)] * 4 + m * 0.3
        m[: n // 3] = m[0] + rng.standard_normal((n // 3, wide)) * 0.05  # a third in one cluster
    m[5] = m[6]
    m[7] = 0
    rows = [(k * 3, x.astype(np.float32).tolist()) for k, x in enumerate(m)]
    queries = [(rows[k][0], rows[k][1]) for k in range(0, n, 60)] + [(10**6, (-m[0]).tolist()), (10**6 + 1, [0.0] * wide)]
    return spark.createDataFrame(rows, "pos long, embedding array<float>").repartition(3), spark.createDataFrame(queries, "query_id long, vector array<float>")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.pos, round(r.score, 6) + 0.0) for r in df.collect())


@pytest.mark.parametrize("clustered,part", [(True, 100), (False, 8192)])
def test_equals_the_plain_search(spark, tmp_path, monkeypatch, clustered, part):
    monkeypatch.setattr(vector_index, "QUERIES", 5)
    v, q = data(spark, 1, clustered)
    vector_index.write_index(v, f"{tmp_path}/ix", clusters=12 if clustered else None, part=part)
    index = vector_index.read_index(spark, f"{tmp_path}/ix")
    for k, own in ((7, False), (30, True)):
        assert rows_of(vector_index.search(q, index, k, own)) == rows_of(vector.search(q, v, k, own))
    assert vector_index.search(q, index, 5000).count() == 1500 * q.count()
    if clustered:
        assert index.clusters.agg(F.max("parts")).first()[0] > 4
        share = vector_index.reads(q, index, 7).agg((F.sum("n_compared") / F.sum("n_vectors")).alias("s"), (F.sum("n_read") / F.sum("n_clusters")).alias("c")).first()
        assert share.c < 0.6 and share.s < 0.7


def test_bounds_hold(spark, tmp_path):
    v, q = data(spark, 2, True, 400)
    vector_index.write_index(v, f"{tmp_path}/ix", clusters=20)
    index = vector_index.read_index(spark, f"{tmp_path}/ix")
    scored = q.join(index.vectors).withColumn("s", F.aggregate(F.zip_with("vector", "embedding", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b))
    best = scored.groupBy("query_id", "cluster").agg(F.max("s").alias("s"))
    assert best.join(vector_index.bounds(q, index), ["query_id", "cluster"]).where("s > bound").isEmpty()


def test_edges(spark, tmp_path):
    v, q = data(spark, 3, False, 90)
    vector_index.write_index(v.where("false"), f"{tmp_path}/none")
    assert vector_index.search(q, vector_index.read_index(spark, f"{tmp_path}/none")).isEmpty()
    with pytest.raises(ValueError):
        vector_index.write_index(v.unionByName(spark.createDataFrame([(1, [1.0])], "pos long, embedding array<float>")), f"{tmp_path}/bad")
    with pytest.raises(FileNotFoundError):
        vector_index.read_index(spark, f"{tmp_path}/bad")
    holes = v.unionByName(spark.createDataFrame([(None, [1.0] * 16), (5000, None)], "pos long, embedding array<float>"))
    vector_index.write_index(holes, f"{tmp_path}/ix")
    asked = q.unionByName(spark.createDataFrame([(None, [1.0] * 16), (77, None)], "query_id long, vector array<float>"))
    assert rows_of(vector_index.search(asked, vector_index.read_index(spark, f"{tmp_path}/ix"), 3)) == rows_of(vector.search(q, v, 3))


def test_nearest_centres_in_bounded_memory():
    """The driver fits centres on the whole sample: what it holds is a slice's products with the centres, not the sample's."""
    import tracemalloc

    rng = np.random.default_rng(4)
    m, centres = rng.standard_normal((20_000, 8)), rng.standard_normal((1024, 8))
    tracemalloc.start()
    near = vector_index._nearest(m, centres)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    some = rng.choice(len(m), 200, replace=False)
    assert (near[some] == np.argmin(((m[some][:, None] - centres) ** 2).sum(axis=2), axis=1)).all()
    assert len(vector_index._nearest(m[:0], centres)) == 0


@pytest.mark.parametrize("same", [False, True])
def test_sample_is_that_of_the_least_hashes(spark, monkeypatch, same):
    """Also where positions repeat, so that few rows or none have such hashes."""
    rows = spark.range(3000).selectExpr("CASE WHEN %s THEN 7 ELSE id END AS pos" % str(same).lower(), "array(cast(CASE WHEN %s THEN 1 ELSE id END AS float)) AS embedding" % str(same).lower())
    sorted_ = []
    kind = type(rows)
    monkeypatch.setattr(kind, "orderBy", lambda self, *by, f=kind.orderBy: sorted_.append(self.count()) or f(self, *by))
    got = vector_index.sampled(rows, 40, 3000).to_pylist()
    want = [r.embedding for r in rows.sort(F.xxhash64("pos"), "pos").limit(40).collect()]
    assert got == want and len(got) == 40 and (same or sorted_[0] < 200)


def test_encoded_vectors_are_made_once(spark, sf001, monkeypatch):
    from studyloom.plans import queries

    plans = []
    monkeypatch.setattr(queries.vector_index, "write_index", lambda df, *a, f=vector_index.write_index: plans.append(df._jdf.queryExecution().toString()) or f(df, *a))
    assert not queries.QUERIES["encoded_neighbours"](spark, sf001).isEmpty()
    assert plans and "MapInArrow" not in plans[0]
