"""Packing: every token placed once, capacity held, little room lost."""

from collections import defaultdict

import numpy as np
import pytest

from quaylight.llm import packing as P


def brute_padding(lengths, counts, buckets):
    n = len(lengths)
    best = {(0, 0): 0}
    for b in range(1, buckets + 1):
        for j in range(n + 1):
            v = [best[b - 1, i] + sum(counts[k] * (lengths[j - 1] - lengths[k]) for k in range(i, j)) for i in range(j) if (b - 1, i) in best]
            if j == 0:
                best[b, 0] = 0
            elif v:
                best[b, j] = min(v)
    return min(v for (b, j), v in best.items() if j == n)


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 60), 12, replace=False))
        counts = rng.integers(1, 30, 12)
        for b in (1, 2, 4):
            got = P.bucket_bounds(lengths, counts, b)
            pad = sum(c * (got[np.searchsorted(got, x)] - x) for x, c in zip(lengths, counts))
            assert len(got) <= b and pad == brute_padding(lengths, counts, b)


def check(rows, items, capacity):
    """Room is never shared, every item is whole."""
    room, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.id].append((r.part_start, r.part_length))
        if r.container_id is not None:
            room[r.container_id].append((r.room_start, r.room_start + r.part_length))
    for c in room.values():
        c.sort()
        assert c[0][0] >= 0 and c[-1][1] <= capacity
        assert all(a[1] <= b[0] for a, b in zip(c, c[1:]))
    want = defaultdict(int)
    for i, n in items:
        want[i] += n or 0
    assert {i: sum(n for _, n in p) for i, p in parts.items()} == want
    return room


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 150)
    rng = np.random.default_rng(2)
    items = [(int(i), int(n)) for i, n in enumerate(np.minimum(rng.lognormal(4, 1, 1500).astype(int) + 1, 900))]
    items += [(5000, 0), (5001, None), (5002, 100), (5003, 250), (5004, 100), (5005, 100)] + [(6000 + i, 37) for i in range(700)]
    df = spark.createDataFrame([(i, n, 1) for i, n in items], "id long, n long, bucket int")
    rows = P.pack(df, "id", "n", 100, 32).collect()
    room = check(rows, items, 100)
    split = {r.id for r in rows if r.part > 0}
    assert split == {i for i, n in items if n and n > 100}
    assert sorted(room) == list(range(len(room)))
    fill = sum(n or 0 for _, n in items) / (100 * len(room))
    assert fill > 0.93
    assert {r.id for r in rows if r.container_id is None} == {5000, 5001}


def test_pack_edges(spark):
    df = spark.createDataFrame([], "id long, n long")
    assert P.pack(df, "id", "n").count() == 0
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 3)], "id long, n long")
    rows = P.pack(df, "id", "n", 16).collect()
    assert len(rows) == 3 and {r.container_id for r in rows} == {0}
    assert P.pack(spark.createDataFrame([(1, 0)], "id long, n long"), "id", "n").first().container_id is None


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = P.pack_texts(d, "doc_id", "text").collect()
    room = defaultdict(int)
    for r in rows:
        if r.container_id is not None:
            room[r.container_id] += r.part_length
    assert {r.doc_id for r in rows} == {r.doc_id for r in d.collect()}
    assert max(room.values()) <= 2048 and sum(room.values()) / (2048 * len(room)) > 0.9
