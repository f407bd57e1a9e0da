"""Neighbours against brute force; edges and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.llm import neighbours as N


def brute(rows, k):
    rows = {i: v for i, v in rows}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x.astype(np.float32) @ x.astype(np.float32).T
    out = {}
    for r, i in enumerate(ids):
        out[int(i)] = [int(ids[c]) for c in sorted((c for c in range(len(ids)) if c != r), key=lambda c: (-s[r, c], ids[c]))[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(y) for y in v], "e") for i, v in rows], "row long, v array<double>, id string")


def test_all_parts_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8)) for i in range(300)]
    got = {r.id: [x.id for x in r.neighbours] for r in N.nearest(frame(spark, rows), "row", "v", 3, 8, coverage=1.0).collect()}
    assert got == brute(rows, 3)


def test_routed_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((250, 16))
    rows = [(i, centres[i % 250] + 0.25 * rng.standard_normal(16)) for i in range(5000)]
    got = {r.id: {x.id for x in r.neighbours} for r in N.nearest(frame(spark, rows), "row", "v", 3, 16, part_rows=500).collect()}
    want = brute(rows, 3)
    recall = sum(len(got[i] & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    assert set(got) == set(want) and recall >= 0.9


def test_small_tables_are_routed_too(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(i, centres[i % 40] + 0.25 * rng.standard_normal(16)) for i in range(600)]
    fitted = []
    fit = N.fit_router
    monkeypatch.setattr(N, "fit_router", lambda x, parts: fitted.append(parts) or fit(x, parts))
    got = {r.id: {x.id for x in r.neighbours} for r in N.nearest(frame(spark, rows), "row", "v", 3, 16).collect()}
    want = brute(rows, 3)
    assert fitted == [4] and sum(len(got[i] & set(w)) for i, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_unusable_and_repeats(spark):
    v = [[1, 0], [2, 0], [0.9, 0.1], [0, 1]]
    rows = list(enumerate(v)) + [(0, v[0]), (9, None), (10, []), (11, [0, 0]), (12, [float("nan"), 1]), (13, [float("inf"), 1]), (14, [1, 2, 3])]
    got = {r.id: [x.id for x in r.neighbours] for r in N.nearest(frame(spark, rows), "row", "v", 3, 2).collect()}
    assert got == {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], 3: [2, 0, 1]}
    pairs = {tuple(r) for r in N.neighbour_pairs(N.nearest(frame(spark, rows), "row", "v", 1, 2)).collect()}
    assert pairs == {(0, 1), (0, 2), (2, 3)}


def test_a_hot_vector_is_answered_exactly(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 2.0, 0.0]) for i in range(400)] + [(400 + i, rng.standard_normal(4)) for i in range(300)]
    got = {r.id: [x.id for x in r.neighbours] for r in N.nearest(frame(spark, rows), "row", "v", 3, 4, coverage=1.0).collect()}
    assert got == brute(rows, 3)


def test_empty_and_lone(spark):
    assert N.nearest(frame(spark, [(1, None)]), "row", "v", 3, 4).count() == 0
    assert N.nearest(frame(spark, [(1, [1, 2, 3, 4])]), "row", "v", 3, 4).count() == 0


def test_balanced_parts():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = N.balanced_parts(x, N.neighbour_graph(x), 8, rng)
    assert np.bincount(label, minlength=8).max() <= 1.08 * 250 + 1


def test_probes_cover():
    p = np.array([[0.7, 0.2, 0.1], [0.99, 0.005, 0.005]])
    r, c = N._probes(p, 0.95)
    assert list(zip(r, c)) == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_recall_is_measured_against_all(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8)) for i in range(400)] + [(900, None)]
    df = frame(spark, rows)
    r = N.recall(N.nearest(df, "row", "v", 3, 8, coverage=1.0), df, "row", "v", 3, 8).first()
    assert (r.queries, r.wanted, r.recall) == (20, 60, 1.0)
