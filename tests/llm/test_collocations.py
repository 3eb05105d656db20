"""Phrases against a plain count; filters against dictionaries."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.llm import collocations as co

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=co.LEAST, covered=co.COVERED, top=co.TOP):
    f = Counter()
    n = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for p, a in candidates.items():
        if len(p) == 4:
            for q in ((p[0], p[1], p[2]), (p[0], p[2], p[3])):
                longer[q] = max(longer[q], a)
    out = {}
    for p, a in candidates.items():
        if len(p) == 3 and 100 * longer[p] >= covered * a and longer[p]:
            continue
        cuts = [(1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.setdefault(p[0], []).append((score, a, " ".join(p[1:]), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, i + 1, p, a, left, right, n[lang], s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "1 AS n", "'x' AS word", "2 AS hash", "3 AS `a.b`")
    return sorted(map(tuple, co.collocations(spark, df.repartition(3), **more).select(*COLUMNS).collect()))


def test_documents(spark, sf001):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("text", "lang").collect()]
    want = brute(rows)
    assert sorted(map(tuple, co.query(spark, sf001).select(*COLUMNS).collect())) == want
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf001}/documents.parquet'")
    assert sorted(duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({co.ORACLE})").fetchall()) == want
    assert len(want) > 100


@pytest.mark.parametrize("held", [50, co.HELD])
def test_odd_texts(spark, monkeypatch, held):
    rng = np.random.default_rng(11)
    alphabet = ["New", "york", "CITY", "hall", "é", "É", "日本", "a\x1cb", "x\x00", "it's", "...", "-", "a", "b"]
    rows = [("".join(str(rng.choice(alphabet)) + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", " - "])) for _ in range(rng.integers(0, 40))), [None, "en", "und", "de"][k % 4]) for k in range(120)]
    rows += [("new york city " * 400, "en"), ("tie tie tie tie tie tie tie tie tie tie tie tie tie", "fr"), (None, "en"), (None, None), ("", "en"), (" \t\n", "en"), ("one two " * 10 + "two one. " * 12, "zz")]
    monkeypatch.setattr(co, "HELD", held)
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, per_block=2) == want
    assert got(spark, rows, top=3) == [r for r in want if r[1] <= 3]
    assert {r[0] for r in want} >= {"und", "en", "de", "zz"}


def test_nothing_often_enough(spark):
    assert got(spark, []) == []
    assert got(spark, [("some words here", "en"), (None, None)]) == []


half = st.integers(0, (1 << 63) - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(half, half, st.integers(1, 1 << 40)), min_size=1, max_size=300), st.sampled_from([(42, 9), (63, 9), (63, 14), (42, 0)]))
def test_filters_lose_nothing(entries, shape):
    bits, block_bits = shape
    mask = (1 << bits) - 1
    a, b, n = co.counted(np.array([x & mask for x, _, _ in entries], np.uint64), np.array([y & mask for _, y, _ in entries], np.uint64), np.array([c for _, _, c in entries], np.int64))
    want = Counter()
    for x, y, c in entries:
        want[x & mask, y & mask] += c
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want
    block = (a >> np.uint64(bits - block_bits)).astype(np.int64)
    for k in np.unique(block).tolist():
        own = block == k
        back = co.from_filter(co.to_filter(a[own], b[own], n[own], bits, block_bits), k, bits, block_bits)
        assert all(np.array_equal(x, y) for x, y in zip(back, (a[own], b[own], n[own]), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, (1 << co.ID_BITS) - 1)] * 3), min_size=1, max_size=50), st.sampled_from([2, 3]))
def test_phrases_come_back(ids, size):
    columns = [np.array([i[k] for i in ids], np.uint64) for k in range(size)]
    a, b, bits = co.pack(columns)
    mixed = co.permute(a, b, bits)
    assert max(int(mixed[0].max()), int(mixed[1].max())) < 1 << bits
    assert all(np.array_equal(x, y) for x, y in zip(co.unpack(*co.restore(*mixed, bits), size), columns, strict=True))


def test_words_that_would_share_an_id(spark):
    low = 64 - co.ID_BITS
    hashes = [5 << low, (5 << low) + 1, 6 << low, 7 << low, (7 << low) + 3, co.RESERVED + 9 << low]
    signed = np.array(hashes, np.uint64).view(np.int64).tolist()
    words = spark.createDataFrame([("en", str(h), h, n) for h, n in zip(signed, [20, 1, 50, 1, 2, 1], strict=True)], "lang string, word string, hash long, n long")
    found = co._shared_ids(words, 10)
    assert sorted(found) == sorted([signed[0], signed[1], signed[5]])
    own = co.Ids(found).of(np.array(hashes, np.uint64)).tolist()
    assert own[2:5] == [6, 7, 7] and len({own[0], own[1], own[2], own[5]}) == 4 and min(own[0], own[1], own[5]) >= co.RESERVED


def test_scores_pass_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, big + 1, big + 7)], "a long, x long, y long").select(co._score("a", "x", "y").alias("s")).first()
    assert row.s == 1000000 * big * big // ((big + 1) * (big + 7))
