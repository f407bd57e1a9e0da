"""The k most similar vectors of every vector, by learned partitions.

Fitting, on the driver, from a bounded sample (``fit_rows``): a neighbour graph of the
sample is cut into balanced parts, and a small network learns to tell a vector's part from
the vector moved about by as much as neighbours differ, so its probabilities say in which
parts neighbours may lie.  Every row is then indexed in its most probable part, and
searched for in the fewest parts whose probabilities reach ``coverage``.

A part is cut into blocks by a hash of the vector, so a part of any size is spread over
tasks.  A block's distinct vectors are held; rows with the same vector beyond the k + 1 smallest ids can't
appear in any list, so they are answered at once and not held.  Queries stream past the block.
A table of ``PART_ROWS`` rows a part has at least ``LEAST_PARTS`` parts; only one of under 128 rows is searched whole.

Defined results: null, empty, wrong-length, all-zero and non-finite vectors take no part;
rows that occur twice in full count once; ties in similarity go to the smaller id;
ids are compared as numbers; a lone vector has no neighbours; an empty table gives an empty one.
Similarities are those of single-precision unit vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part, about; and of a block of it.
PART_ROWS = 4096
BLOCK_ROWS = 8192
MAX_PARTS = 1024
#: Parts of a small table, if it has so many rows for each.
LEAST_PARTS, ROWS_TO_FIT = 4, 64
COVERAGE = 0.82
HIDDEN = 96
#: Length of the noise added to a unit vector in training: where its neighbours may lie.
NOISE = 0.3
_TILE = 1 << 22


def fit_rows(parts: int) -> int:
    """Size of the fitting sample."""
    return int(min(65536, max(8192, 256 * parts)))


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k nearest of each row of unit vectors, itself left out."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int32)
    step = max(1, _TILE // n)
    for lo in range(0, n, step):
        s = x[lo : lo + step] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        out[lo : lo + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.08) -> np.ndarray:
    """Part of each vertex: grown around centres, then moved along graph edges, sizes bound."""
    n = len(x)
    most = math.ceil(slack * n / parts)
    centres = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int32)
    for _ in range(8):
        s = x @ centres.T
        label = _within(s, most)
        for p in range(parts):
            c = x[label == p].sum(0)
            norm = np.linalg.norm(c)
            if norm > 0:
                centres[p] = c / norm
    for sweep in range(12):
        votes = np.zeros((n, parts), np.float32)
        for j in range(graph.shape[1]):
            votes[np.arange(n), label[graph[:, j]]] += 1
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        move = np.nonzero((gain > 0) & (rng.random(n) < 0.5))[0]
        if len(move) == 0:
            break
        size = np.bincount(label, minlength=parts)
        for v in move[np.argsort(-gain[move], kind="stable")]:
            if size[want[v]] < most:
                size[label[v]] -= 1
                label[v] = want[v]
                size[want[v]] += 1
    return label


def _within(s: np.ndarray, most: int) -> np.ndarray:
    """Best column of each row with at most ``most`` rows a column; the surest choose first."""
    n, p = s.shape
    label = np.full(n, -1, np.int32)
    left = np.full(p, most)
    todo = np.arange(n)
    s = s.copy()
    while len(todo):
        best = s[todo].argmax(1)
        over = []
        for c in np.unique(best):
            rows = todo[best == c]
            if len(rows) > left[c]:
                rows = rows[np.argsort(-s[rows, c], kind="stable")]
                over.append(rows[left[c] :])
                rows = rows[: left[c]]
            label[rows] = c
            left[c] -= len(rows)
            if left[c] == 0:
                s[:, c] = -np.inf
        todo = np.concatenate(over) if over else np.empty(0, int)
    return label


class Router:
    """A network of one hidden layer from unit vectors to part probabilities."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.w1 = (rng.standard_normal((dim, HIDDEN)) * math.sqrt(2 / dim) * 2).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = (rng.standard_normal((HIDDEN, parts)) * math.sqrt(2 / HIDDEN)).astype(np.float32)
        self.b2 = np.zeros(parts, np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, label: np.ndarray, rng: np.random.Generator, epochs: int = 40, batch: int = 256, rate: float = 0.004) -> "Router":
        """Adam on the cross entropy of the parts of moved vectors."""
        names = ("w1", "b1", "w2", "b2")
        m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        steps = epochs * math.ceil(len(x) / batch)
        scale = NOISE / math.sqrt(x.shape[1])
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                i = order[lo : lo + batch]
                y = x[i] + scale * rng.standard_normal((len(i), x.shape[1]), dtype=np.float32)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                a = np.maximum(y @ self.w1 + self.b1, 0)
                z = a @ self.w2 + self.b2
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), label[i]] -= 1
                g = p / len(i)
                h = (g @ self.w2.T) * (a > 0)
                t += 1
                lr = rate * (1 - 0.9 * t / steps)
                for k, d in zip(names, (y.T @ h, h.sum(0), a.T @ g, g.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    setattr(self, k, (getattr(self, k) - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
        return self


def fit_router(x: np.ndarray, parts: int, seed: int = 11) -> tuple[Router | None, np.ndarray]:
    """A router over ``parts`` parts of the sample, and the share of the sample in each."""
    if parts <= 1 or len(x) < 2 * parts:
        return None, np.ones(1)
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts, rng)
    router = Router(x.shape[1], parts, rng).fit(x, label, rng)
    return router, np.bincount(router.probabilities(x).argmax(1), minlength=parts) / len(x)


def _units(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and single-precision unit vectors of the usable rows of a list column."""
    col = col.cast(pa.list_(pa.float64()))
    size = np.asarray(pa.compute.list_value_length(col).fill_null(-1))
    at = np.nonzero(size == dim)[0]
    flat = col.take(pa.array(at)).flatten()
    x = np.asarray(flat.fill_null(np.nan), dtype=np.float64).reshape(len(at), dim)
    big = np.abs(x).max(1, initial=0)
    ok = np.isfinite(big) & (big > 0) & np.isfinite(x).all(1)
    x = x[ok] / big[ok, None]
    return at[ok], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _probes(p: np.ndarray, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and parts of all probes; a row's first is its most probable part.  A coverage of 1 is the exact way: every part."""
    order = np.argsort(-p, axis=1, kind="stable")
    total = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
    use = np.concatenate([np.ones((len(p), 1), bool), (total[:, :-1] < coverage) | (coverage >= 1)], axis=1)
    r, c = np.nonzero(use)
    return r, order[r, c]


class _Block:
    """The vectors of one block and the search among them."""

    def __init__(self, k: int):
        self.k, self.ids, self.vecs, self.same = k, [], [], {}
        self.base: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, i: int, v: bytes) -> list[int] | None:
        """Take a row in; the row's neighbours if its vector is already there often enough."""
        seen = self.same.setdefault(v, [])
        if i in seen:
            return []
        if len(seen) > self.k:
            return seen[: self.k]
        seen.append(i)
        self.ids.append(i)
        self.vecs.append(v)
        return None

    def close(self, dim: int) -> None:
        self.base = np.array(self.ids, np.int64), np.frombuffer(b"".join(self.vecs), np.float32).reshape(-1, dim)

    def search(self, qid: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query positions, neighbour ids and similarities, at most k a query, all different from it."""
        bid, b = self.base
        if len(bid) == 0:
            return
        bt = np.ascontiguousarray(b.T)
        step = max(1, _TILE // len(bid))
        for lo in range(0, len(qid), step):
            s = q[lo : lo + step] @ bt
            rows = np.arange(len(s))
            at = np.searchsorted(bid, qid[lo : lo + step])
            at = np.minimum(at, len(bid) - 1)
            own = bid[at] == qid[lo : lo + step]
            s[rows[own], at[own]] = -9
            for _ in range(self.k):
                best = s.argmax(1)  # the first of equals, hence the smallest id
                sim = s[rows, best]
                ok = sim > -8
                yield lo + rows[ok], bid[best[ok]], sim[ok]
                s[rows, best] = -9


def nearest(df: DataFrame, key: str, vector: str, k: int = 3, dim: int = 48, coverage: float = COVERAGE, part_rows: int = PART_ROWS) -> DataFrame:
    """One row a usable vector: id, neighbours (array of similarity, id; best first)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(f"id is not null and size(v) = {dim}")
    n = rows.count()
    parts = min(MAX_PARTS, max(min(LEAST_PARTS, n // ROWS_TO_FIT), math.ceil(n / part_rows)))
    router, share = None, np.ones(1)
    if parts > 1:
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows(parts)).select("v").toArrow()
        router, share = fit_router(_units(sample.column(0).combine_chunks(), dim)[1], parts)
    blocks = np.maximum(1, np.ceil(share * n / BLOCK_ROWS)).astype(int)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _units(b.column(1), dim)
            ids = np.asarray(b.column(0))[at]
            r, part = (np.arange(len(x)), np.zeros(len(x), int)) if router is None else _probes(router.probabilities(x), coverage)
            first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.empty(0, bool)
            bits = x.view(np.uint32).astype(np.uint64) @ (np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(x) else np.empty(0, np.uint64)
            home = ((bits >> np.uint64(33)).astype(np.int64))[r] % blocks[part]
            # the home block of a first probe also indexes the row; every block of a probed part is searched
            rep = blocks[part]
            src = np.repeat(np.arange(len(r)), rep)
            blk = np.arange(len(src)) - np.repeat(np.cumsum(rep) - rep, rep)
            index = first[src] & (blk == home[src])
            raw = x.tobytes()
            w = 4 * dim
            vec = [raw[w * i : w * i + w] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[src].astype(np.int32)), pa.array(blk.astype(np.int32)), pa.array((~index).astype(np.int8)), pa.array(ids[r[src]]), pa.array([vec[i] for i in r[src]], pa.binary())], names=["part", "blk", "late", "id", "vec"]
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cur = None, None

        def answer(qid: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            for p, i, s in block.search(qid, q):
                yield pa.RecordBatch.from_arrays([pa.array(qid[p]), pa.array(s.astype(np.float64)), pa.array(i)], names=["id", "similarity", "neighbour"])

        def closed() -> Iterator[pa.RecordBatch]:
            if block is not None and block.base is None:
                block.close(dim)
                yield from answer(*block.base)

        for b in batches:
            part, blk, late, ids = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
            vec, done = b.column(4), []
            q = np.frombuffer(vec.buffers()[2], np.float32, len(ids) * dim, vec.offset * 4 * dim).reshape(-1, dim)
            # rows come sorted by part, block and lateness: work goes by runs of equal ones
            new = np.nonzero((part[1:] != part[:-1]) | (blk[1:] != blk[:-1]) | (late[1:] != late[:-1]))[0] + 1
            for lo, hi in zip([0, *new], [*new, len(ids)]):
                if (part[lo], blk[lo]) != cur:
                    yield from closed()
                    block, cur = _Block(k), (part[lo], blk[lo])
                if late[lo]:
                    yield from closed()
                    yield from answer(ids[lo:hi], q[lo:hi])
                    continue
                raw = q[lo:hi].tobytes()
                w = 4 * dim
                for n, i in enumerate(ids[lo:hi].tolist()):
                    done += [(i, j) for j in block.add(i, raw[w * n : w * n + w]) or ()]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([1.0] * len(done)), pa.array([x[1] for x in done], pa.int64())], names=["id", "similarity", "neighbour"])
        yield from closed()

    routed = rows.mapInArrow(route, "part int, blk int, late tinyint, id long, vec binary")
    grouped = routed.repartition("part", "blk").sortWithinPartitions("part", "blk", "late", "id")
    found = grouped.mapInArrow(search, "id long, similarity double, neighbour long")
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("minus"), F.col("neighbour").alias("id")))), 1, k)
    return found.groupBy("id").agg(F.transform(best, lambda s: F.struct((-s["minus"]).alias("similarity"), s["id"].alias("id"))).alias("neighbours"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Each pair of which one is in the other's list, once: id_a < id_b."""
    p = found.select("id", F.explode("neighbours.id").alias("other"))
    return p.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def recall(found: DataFrame, df: DataFrame, key: str, vector: str, k: int = 3, dim: int = 48, every: int = 20) -> DataFrame:
    """queries, wanted, hit, recall: ``found`` against an exact search for the rows whose id is divisible by ``every``.

    A query whose exact list ends in a tie of single-precision similarities may differ in its last place.
    """
    from quaylight.operators.topk import exact_top_k

    v = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(f"id is not null and size(v) = {dim}")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).dropDuplicates(["id"])
    exact = exact_top_k(v.where(F.col("id") % every == 0), v, k).select(F.col("query_id").alias("id"), F.col("id").alias("other"))
    got = found.select("id", F.explode("neighbours.id").alias("other"), F.lit(1).alias("hit"))
    j = exact.join(got, ["id", "other"], "left")
    return j.agg(F.count_distinct("id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hit")).withColumn("recall", F.col("hit") / F.col("wanted"))
