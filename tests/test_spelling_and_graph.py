"""Corrections against all pairs of words, strong components and levels against plain search."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.operators import graph_build, spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_corrections_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcde"), n)) for n in (4, 5, 6, 7, 8, 9, 10, 12) for _ in range(6)]
    words = [w for w in base for _ in range(int(rng.integers(20, 30)))]
    for w in base * 6:  # one to three edits
        x = list(w)
        for _ in range(int(rng.integers(1, 4))):
            i = int(rng.integers(0, len(x)))
            x[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("abcde"), int(rng.integers(0, 3))))
        words.append("".join(x))
    words += ["é" + base[0], "ABCDEABC", "abc"]
    docs = [(k, " ".join(words[k::40])) for k in range(40)] + [(99, None), (100, "")]
    got = {r.word: tuple(r) for r in spelling.corrections(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    n = Counter(w.lower() for w in words if len(w) >= 4 and w.isascii() and w)
    want = {}
    for w, c in n.items():
        if c <= spelling.SUSPECT:
            near = [(d, -m, v) for v, m in n.items() if m >= spelling.KNOWN and (d := distance(w, v)) <= (2 if len(w) >= spelling.LONG else 1)]
            if near:
                d, m, v = min(near)
                want[w] = (w, c, v, d, -m)
    assert got == want and len(want) > 60
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert spelling.corrected(frame, spelling.corrections(frame)).agg(F.sum("n_corrected")).first()[0] == sum(n[w] for w in want)


def test_forms_without_partner_stay_out_of_the_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    known = [word(9) for _ in range(40)]
    rare = [word(11) for _ in range(2000)] + [w[:-1] for w in known]
    kept = []
    made = spelling.may_meet

    def seen(rows, own, n):
        out = made(rows, own, n)
        kept.append((rows.count(), out.count(), rows.join(own, "form", "left_semi").select(*rows.columns).exceptAll(out).count()))
        return out

    monkeypatch.setattr(spelling, "may_meet", seen)
    frame = spark.createDataFrame([(" ".join(known * 20 + rare),)], "text string")
    got = spelling.corrections(frame)
    assert {(r.word, r.correction) for r in got.collect()} >= {(w[:-1], w) for w in known}
    (every, left, lost), plan = kept[0], got._jdf.queryExecution().toString()
    assert every > 100_000 and left < every / 10 and lost == 0
    assert "SortMergeJoin" in plan  # the known words' forms aren't sent whole


def plain_components(nodes, edges):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed,n,m", [(1, 40, 60), (2, 60, 55), (3, 12, 60)])
def test_strong_components_and_levels(spark, seed, n, m):
    rng = np.random.default_rng(seed)
    edges = [(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, n, (m, 2))]
    nodes = [f"n{k:02}" for k in range(n + 3)]
    frame = spark.createDataFrame([(x,) for x in nodes], "node string")
    got = graph_build.strong_components(frame, spark.createDataFrame(edges, "a string, b string"))
    want = plain_components(nodes, edges)
    assert {r.node: r.component for r in got.collect()} == want
    # edges run from a prerequisite to what needs it
    level = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in edges:
            if want[a] != want[b]:
                high = max(level[b], level[a] + 1)
                for x in nodes:
                    if want[x] == want[b]:
                        level[x] = max(level[x], high)
    out = graph_build.levels(got, spark.createDataFrame([(b, a) for a, b in edges], "node string, prerequisite string"))
    assert {r.node: r.level for r in out.collect()} == level


def test_long_cycle_and_chain(spark):
    edges = [(k, (k + 1) % 30) for k in range(30)] + [(k, k + 1) for k in range(100, 140)]
    nodes = spark.createDataFrame([(k,) for k in [*range(30), *range(100, 141), 500]], "node long")
    got = {r.node: r.component for r in graph_build.strong_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 if k < 30 else k for k in got} and len(got) == 72


def test_edges_of_tags(spark):
    tags = [(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "c", None]), (4, ["a"]), (5, None), (6, []), (7, ["x", "y"]), (8, ["y", "x", "x"])]
    got = {r.node: tuple(r)[1:] for r in graph_build.build(spark.createDataFrame(tags, "doc_id long, tags array<string>")).collect()}
    # b and c need a, which is in all their documents; x and y need each other
    assert got == {"a": (4, "a", 0, []), "b": (2, "b", 1, ["a"]), "c": (2, "c", 1, ["a"]), "x": (2, "x", 0, ["y"]), "y": (2, "x", 0, ["x"])}
    assert graph_build.build(spark.createDataFrame([], "doc_id long, tags array<string>")).isEmpty()
