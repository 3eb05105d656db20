"""Vector near-duplicates against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from studyloom.llm import vector_dedup as vd

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n double, keys int, `a.b` int"


def brute(rows, threshold=vd.THRESHOLD):
    """(n_links, component) by position, of rows with distinct ids."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    label, links = {i: rows[i][0] for i in good}, dict.fromkeys(range(len(rows)), 0)
    near = []
    for i in good:
        for j in good:
            a, b = np.float64(np.float32(rows[i][1])), np.float64(np.float32(rows[j][1]))
            if i != j and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links[i] += 1
                near.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if label[j] < label[i]:
                label[i], changed = label[j], True
    return {i: (links[i], label.get(i, k), k is not None and label.get(i, k) == k) for i, (k, _) in enumerate(rows)}


def planted(rng, wide=16):
    """A large group of near copies, chains, copies, opposites, scaled copies, short vectors, and what takes no part."""
    base = rng.standard_normal(wide)
    vectors = [list(base + 0.04 * rng.standard_normal(wide)) for _ in range(90)] + [list(base)] * 25
    for _ in range(15):
        v = rng.standard_normal(wide)
        vectors += [list(v), list(-v), list(v * 1e20), list(v * 1e-20)]
        for _ in range(4):
            v = v + 0.2 * rng.standard_normal(wide)
            vectors.append(list(v))
    vectors += [list(rng.standard_normal(wide)) for _ in range(60)] + [list(rng.standard_normal(3) + [9, 0, 0]) for _ in range(8)]
    vectors += [None, [], [0.0] * wide, [float("nan")] + [1.0] * (wide - 1), [None] + [1.0] * (wide - 1), [float("inf")] * wide]
    return [(int(k), v) for k, v in zip(rng.permutation(len(vectors)) * 3 - 100, vectors, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1.0, 2, 3) for k, v in rows], SCHEMA)


@pytest.mark.parametrize("block", [7, vd.BLOCK])
def test_equals_all_pairs(spark, block):
    rows = planted(np.random.default_rng(3))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(spark, frame(spark, rows).repartition(5), miss=1e-9, block=block).collect()}
    want = {rows[i][0]: v for i, v in brute(rows).items()}
    assert max(n for n, _, _ in want.values()) > 100
    assert got == want


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest ones."""
    rng, rows, wide = np.random.default_rng(5), [], 32
    for k in range(400):
        a, b = rng.standard_normal(wide), rng.standard_normal(wide)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * k, list(a)), (2 * k + 1, list(0.951 * a + math.sqrt(1 - 0.951**2) * b))]
    out = vd.near_duplicates(spark, frame(spark, rows)).collect()
    linked = [r for r in out if r.n_links]
    assert all(r.component_id == r.vec_id // 2 * 2 for r in linked)
    assert len(linked) >= 0.98 * len(rows)


def test_edges(spark):
    assert vd.near_duplicates(spark, frame(spark, [])).count() == 0
    v = [1.0, 2.0, 3.0]
    rows = [(None, v), (None, None), (4, v), (4, v), (9, v), (11, [3.0, -2.0, 1.0]), (11, [3.0, -2.0, 1.01]), (12, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(spark, frame(spark, rows)).collect()), key=str)
    # copies count by row; rows that share an id are one vector and don't link with each other unless equal
    assert got == sorted([(None, 0, None, False)] * 2 + [(4, 2, 4, True)] * 2 + [(9, 2, 4, False), (11, 0, 11, True), (11, 0, 11, True), (12, 0, 12, True)], key=str)


def test_parameters_keep_the_recall():
    for n in (10, 10**4, 10**7, 10**11):
        bits, tables = vd.parameters(n)
        p = 1 - math.acos(vd.THRESHOLD) / math.pi
        assert (1 - p**bits) ** tables <= vd.MISS and 2**bits >= n
