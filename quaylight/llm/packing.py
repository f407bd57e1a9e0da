"""Laying items of varying length into containers of fixed capacity.

1. The histogram of lengths (at most one row for each length up to the capacity) is
   the only thing the driver sees of the items.
2. Dynamic programming over it chooses bucket bounds that minimise padding, the
   room lost when every item of a bucket takes the bucket's bound.
3. Containers are planned over buckets alone: a pattern says how many items of each
   bucket share a container, and how often it is used.  A pattern starts with the
   longest bucket left and takes the longest that still fits, so the room which a
   batch of one bucket leaves goes to items of shorter buckets.
4. Each item learns its place from its bucket and its rank within it.  Ranks are
   counted in hashed shards of bounded size, so no bucket, however full, meets in one task.

Only an item longer than the capacity is split, into full pieces and a rest.

Defined results: items of length 0 or null get no container (null); repeated rows are
items of their own; ties in length are ordered by key; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.session import materialize

CAPACITY = 2048
BUCKETS = 256
#: Items ranked together in one shard, about.
SHARD_ROWS = 200_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascending and distinct.  One layer of the programme adds one bucket;
    a layer's best first length never falls as its last rises, so halving finds
    each layer in O(n log n) vector steps.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    c = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)

    def cost(i, j):  # items i..j-1 in a bucket bound by lengths[j-1]
        return lengths[j - 1] * (c[j] - c[i]) - (s[j] - s[i])

    best = np.concatenate([[0.0], cost(np.zeros(n, int), np.arange(1, n + 1))])
    cuts = np.zeros((buckets, n + 1), np.int32)
    for b in range(1, buckets):
        new, arg = np.full(n + 1, np.inf), cuts[b]
        new[0] = 0.0
        stack = [(1, n, 0, n)]
        while stack:
            lo, hi, alo, ahi = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(alo, min(mid, ahi + 1))
            if len(i) == 0:
                i = np.array([mid - 1])
            v = best[i] + cost(i, np.full(len(i), mid))
            k = int(np.argmin(v))
            new[mid], arg[mid] = v[k], i[k]
            stack += [(lo, mid - 1, alo, int(i[k])), (mid + 1, hi, int(i[k]), ahi)]
        best = new
    out, j = [], n
    for b in range(buckets - 1, -1, -1):
        out.append(lengths[j - 1])
        j = int(cuts[b][j]) if b else 0
        if j == 0:
            break
    return np.array(sorted(out))


def plan_containers(bounds: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(bucket, items)], each with the number of containers that use it."""
    left = counts.astype(np.int64).copy()
    plan = []
    while left.any():
        room, pattern, j = capacity, [], int(np.nonzero(left)[0][-1])
        while j >= 0:
            k = int(min(left[j], room // bounds[j]))
            if k:
                pattern.append((j, k))
                room -= k * int(bounds[j])
            j -= 1
            while j >= 0 and (left[j] == 0 or bounds[j] > room):
                j -= 1
        times = min(int(left[j]) // k for j, k in pattern)
        for j, k in pattern:
            left[j] -= times * k
        plan.append((pattern, times))
    return plan


def pack(items: DataFrame, key: str, length: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """One row a piece: key, part, part_start, part_length, container_id, room_start.

    ``room_start`` is where the piece begins in its container.  ``items`` is read
    three times; give it a materialised table.
    """
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    parts = items.select(F.col(key).alias("key"), n.alias("n")).where("n >= 0")
    pieces = parts.where("n > 0").select("key", F.posexplode(F.expr(f"transform(sequence(0L, (n - 1) div {capacity}), i -> struct(i * {capacity} as start, least(n - i * {capacity}, {capacity}L) as len))")).alias("part", "p"))
    pieces = pieces.select("key", "part", F.col("p.start").alias("part_start"), F.col("p.len").alias("part_length"))
    hist = pieces.groupBy("part_length").count().orderBy("part_length").collect()  # at most `capacity` rows
    none = parts.where("n = 0").select("key", F.lit(0).alias("part"), F.lit(0).cast("long").alias("part_start"), F.col("n").alias("part_length"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("room_start"))
    named = [F.col("key").alias(key), "part", "part_start", "part_length", "container_id", "room_start"]
    if not hist:
        return none.select(*named)
    lengths, counts = np.array([r[0] for r in hist]), np.array([r[1] for r in hist])
    bounds = bucket_bounds(lengths, counts, buckets)
    of = np.searchsorted(bounds, lengths)
    plan = plan_containers(bounds, np.bincount(of, counts, len(bounds)).astype(np.int64), capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, container = np.zeros(len(bounds), np.int64), 0
    for pattern, times in plan:
        at = 0
        for j, k in pattern:
            slots.setdefault(j, []).append((int(taken[j]), container, k, at))
            taken[j] += times * k
            at += k * int(bounds[j])
        container += times
    slots = {j: np.array(v, np.int64) for j, v in slots.items()}

    @F.pandas_udf("container_id long, room_start long")
    def place(bucket: pd.Series, rank: pd.Series) -> pd.DataFrame:
        b, r = bucket.to_numpy(), rank.to_numpy()
        cont, room = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
        for j in np.unique(b):
            i = np.nonzero(b == j)[0]
            s = slots[int(j)]
            p = np.searchsorted(s[:, 0], r[i], side="right") - 1
            off = r[i] - s[p, 0]
            cont[i] = s[p, 1] + off // s[p, 2]
            room[i] = s[p, 3] + off % s[p, 2] * bounds[j]
        return pd.DataFrame({"container_id": cont, "room_start": room})

    shards = math.ceil(int(counts.sum()) / SHARD_ROWS)
    of_length = np.searchsorted(bounds, np.arange(1, int(bounds[-1]) + 1))
    bucket = F.expr(f"array({', '.join(map(str, of_length))})")[F.col("part_length").cast("int") - 1]
    pieces = pieces.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int"))
    sizes = pieces.groupBy("bucket", "shard").count()
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("key", "part")) - 1
    ranked = pieces.withColumn("rank", rank).join(sizes, ["bucket", "shard"])
    placed = ranked.withColumn("at", place("bucket", F.col("base") + F.col("rank")))
    return placed.select("key", "part", "part_start", "part_length", "at.container_id", "at.room_start").unionByName(none).select(*named)


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``pack`` over the token counts of ``text``, which are written once to the shared folder."""
    from quaylight.llm.tokens import token_counts

    return pack(materialize(token_counts(df, text, [key]), "sizes"), key, "n_tokens", capacity, buckets)
