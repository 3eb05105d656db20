"""The pipeline against brute force, stage by stage, on a small fixture."""

from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline
from studyloom.llm import quality

from .test_operators import SCHEMA, WORD, brute_components, brute_lines, brute_targets


def fixture(spark, tmp_path):
    rng = np.random.default_rng(21)

    def prose(n):
        out = []
        for i in range(n):
            w = "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
            out.append(w + ("." if i % 9 == 8 else ""))
        return " ".join(out)

    passage = "\n".join(prose(15) for _ in range(9))
    texts = [prose(60) + "\n" + prose(40) for _ in range(40)]
    texts += [prose(20) + "\n" + passage + "\n" + prose(20) for _ in range(6)]
    texts += [t.replace(t.split()[50], "changed", 1) for t in texts[:8]] + texts[8:12]
    texts += ["### $$$ %%% " * 30, "BUY NOW!! " * 40, "too short", "", None]
    rows = [(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), {i: t for i, t in enumerate(texts)}


def test_stages(spark, tmp_path):
    d, texts = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in quality.assess(spark, docs).where("kept").collect()}
    clean = set(range(58))
    assert clean <= kept and not kept & set(range(58, 63))

    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = frames[name] = spark.read.parquet(f"{d}/{name}")
        if name != "bpe_encode_decode":
            assert docs.schema.simpleString() == frames["quality_rules"].schema.simpleString()

    one = frames["quality_rules"]
    assert {(r.doc_id, r.text) for r in one.collect()} == {(i, texts[i]) for i in kept}
    two = sorted((r.doc_id, r.text) for r in frames["line_dedup"].collect())
    assert two == sorted(brute_lines(spark, one)) and sum(len(t) for _, t in two) < sum(len(texts[i]) for i in kept)
    assert all(r.n_chars == len(r.text) for r in frames["line_dedup"].collect())
    label = brute_components(dict(two), 5, 8, 10)
    stay = {i for i, (_, c) in label.items() if c == i}
    assert {r.doc_id for r in frames["ngram_jaccard_join"].collect()} == stay and len(stay) < len(two)
    sizes, took, words = Counter(), Counter(), {}
    for r in frames["ngram_jaccard_join"].collect():
        words[r.doc_id] = len(WORD.findall(r.text))
        sizes[r.source] += words[r.doc_id]
    for r in frames["mixing_sources"].collect():
        took[r.source] += words[r.doc_id]
    want = brute_targets(sizes)
    assert all(abs(took[s] - want[s]) <= 2 * max(words.values()) + 1 for s in sizes)
    assert frames["bpe_encode_decode"].count() == frames["mixing_sources"].count()

    ran = corpus_pipeline.run(spark, d)
    assert Counter(map(tuple, ran.collect())) == Counter(map(tuple, frames["bpe_encode_decode"].collect()))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing_sources", "bpe_encode_decode"]
