"""The fitted encoder against TF-IDF cosines and for finding copies."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from studyloom.operators import encoder


def test_cosines_estimate_those_of_tfidf(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").limit(120)
    fitted = encoder.fit(docs)
    encoder.save(fitted, spark, f"{tmp_path}/model")
    again = encoder.load(spark, f"{tmp_path}/model")
    assert again.n_docs == fitted.n_docs and np.array_equal(again.df, fitted.df)
    got = {r.doc_id: np.array(r.vector) for r in encoder.encode(docs, again, "doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = {k: Counter(re.findall(r"[^\W\d_]+", t.lower())) for k, t in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    weight = {k: {w: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()} for k, c in counts.items()}
    ids = sorted(k for k in texts if counts[k])
    wrong = []
    for i in ids[:60]:
        for j in ids[60:]:
            dot = sum(x * weight[j].get(w, 0) for w, x in weight[i].items())
            cosine = dot / np.sqrt(sum(x * x for x in weight[i].values()) * sum(x * x for x in weight[j].values()))
            wrong.append(got[i] @ got[j] - cosine)
    assert abs(np.mean(wrong)) < 0.03 and np.std(wrong) < 2 / np.sqrt(encoder.DIMENSION)


def test_edges(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, "some words here"), (3, None), (4, "12 34"), (5, "other things entirely")], "k long, text string")
    out = {r.k: np.array(r.vector) for r in encoder.encode(df, encoder.fit(df), "k").collect()}
    assert np.array_equal(out[1], out[2]) and not out[3].any() and not out[4].any()
    assert abs(out[1] @ out[1] - 1) < 1e-6 and out[1] @ out[5] < 0.5
    none = encoder.fit(df.where("false"))
    assert none.n_docs == 0 and encoder.encode(df.where("false"), none, "k").isEmpty()
