"""Exact top-k by similarity: a stated set of queries against all rows, in blocks.

The queries go to the workers as one small table of vectors, in batches of a bounded size; each batch
passes over all rows once and every partition keeps its best k of each query, so
only k rows a query and partition are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by a task at a time.
QUERY_BLOCK = 4096
#: Rows compared with them at a time.
ROW_BLOCK = 1024
#: Rows of a stretch of time from which it is cut into blocks.
BAND_BLOCK = 16384
#: Cells of a table of similarities, and pairs measured exactly, at a time.
CELLS = 1 << 22
#: More than single precision errs in the cosine of two unit vectors of some hundred numbers.
SLACK = 2e-5


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int, least: float = -2.0, blocks: int | None = None) -> DataFrame:
    """query_id, id, similarity: the k rows of highest cosine of each query, itself left out; ties to the smaller id.

    ``queries`` and ``rows`` are (id long, v array of double).  Query blocks meet row blocks by a key, so
    neither side is collected or broadcast whole.
    """
    n = queries.count()
    qb = max(1, -(-n // QUERY_BLOCK))
    rb = blocks or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = queries.select(F.lit(0).alias("side"), F.col("id"), F.col("v"), F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
    r = rows.select(F.lit(1).alias("side"), F.col("id"), F.col("v"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(rb)).cast("int").alias("rb"))
    both = q.select("qb", "rb", "side", "id", "v").unionByName(r.select("qb", "rb", "side", "id", "v"))
    both = both.where(F.col("v").isNotNull() & (F.size("v") > 0)).repartition("qb", "rb").sortWithinPartitions("qb", "rb", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, qid, qv, best = None, [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if best is not None:
                ok = best[0] >= least
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(qid, np.int64)[i]), pa.array(best[1][i, j]), pa.array(best[0][i, j])], names=["query_id", "id", "similarity"])

        for b in batches:
            d = b.to_pydict()
            at = 0
            m = b.num_rows
            while at < m:
                key = (d["qb"][at], d["rb"][at])
                if key != cur:
                    yield from flush()
                    cur, qid, qv, best = key, [], [], None
                side = d["side"][at]
                end = at
                while end < m and (d["qb"][end], d["rb"][end]) == key and d["side"][end] == side:
                    end += 1
                if side == 0:
                    qid += d["id"][at:end]
                    qv += d["v"][at:end]
                elif qid:
                    if best is None:
                        width = max(len(v) for v in qv)
                        unit_q = _units(qv, width)
                        best = np.full((len(qid), k), -9.0), np.full((len(qid), k), np.iinfo(np.int64).max)
                    for lo in range(at, end, ROW_BLOCK):
                        best = _merged(best, unit_q, np.array(qid), np.array(d["id"][lo : min(end, lo + ROW_BLOCK)], np.int64), _units(d["v"][lo : min(end, lo + ROW_BLOCK)], width))
                at = end
        yield from flush()

    found = both.mapInArrow(run, "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.where("similarity > -9").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def _merged(best: tuple, q: np.ndarray, qid: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best so far and the best of some more rows, whose ids ascend; of equals the first, hence the smaller id."""
    k = best[0].shape[1]
    s = q @ rows.T
    at = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
    own = ids[at] == qid
    every = np.arange(len(q))
    s[every[own], at[own]] = -9.0
    sims, who = [best[0]], [best[1]]
    for _ in range(min(k, len(ids))):
        j = s.argmax(axis=1)
        sims.append(s[every, j][:, None])
        who.append(ids[j][:, None])
        s[every, j] = -9.0
    sims, who = np.concatenate(sims, 1), np.concatenate(who, 1)
    top = np.lexsort((who, -sims), axis=1)[:, :k]
    return np.take_along_axis(sims, top, 1), np.take_along_axis(who, top, 1)


def _units(vs: list, width: int) -> np.ndarray:
    """Unit rows; a vector of another length or without direction is all zero."""
    x = np.zeros((len(vs), width))
    for i, v in enumerate(vs):
        if len(v) == width:
            x[i] = v
    x[~np.isfinite(x).all(1)] = 0
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def recent_alike(rows: DataFrame, width_us: int, k: int, least: float, block: int | None = None) -> DataFrame:
    """new_id, old_id, similarity: for each row the k most alike of the rows less than ``width_us`` before it (at equal times those of smaller id), of at least that cosine; ties to the smaller id.

    ``rows`` are (id long, us long, v array of double): vectors of one length, finite and not all zero.  The rows of a stretch of ``width_us``
    meet each other and those of the stretch before.  Stretches are counted first; a full one gets blocks by a hash, and every pair of blocks is a group of its
    own.  A group is a product of matrices in single precision; what may reach the bound is measured again exactly, and only the best k of each row leave it.
    """
    block = block or BAND_BLOCK
    rows = rows.where("us is not null").withColumn("bk", F.floor(F.col("us") / width_us))
    n = rows.groupBy("bk").count()
    met = lambda x: F.explode(F.array(x, x + 1)).alias("bk")
    most = n.select(met(F.col("bk")), "count").groupBy("bk").agg(F.ceil(F.sum("count") / block).cast("int").alias("blocks"))
    both = rows.select("id", "us", "v", F.xxhash64("id", "us", "v").alias("hash"), F.col("bk").alias("of"), met(F.col("bk"))).join(most.join(n.select("bk"), "bk", "left_semi"), "bk")
    own, other = F.pmod("hash", F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = both.select("bk", "id", "us", "v", (F.col("of") == F.col("bk")).alias("now"), own.alias("own"), other.alias("other"))
    both = both.select("bk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "now", "id", "us", "v")

    def run(t: pa.Table) -> pa.Table:
        i, j, own, now = (t[c].to_numpy() for c in ("i", "j", "own", "now"))
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        ids, us = t["id"].combine_chunks(), t["us"].to_numpy()
        found = [_alike(v, ids, us, new, old, width_us, k, least) for new, old in ((now & (own == i), own == j), (now & (own == j), own == i))[: 1 + int(i[0] != j[0])]]
        new, old, sim = (np.concatenate(x) for x in zip(*found))
        return pa.table({"new_id": ids.take(pa.array(new)), "old_id": ids.take(pa.array(old)), "similarity": sim})

    found = both.groupBy("bk", "i", "j").applyInArrow(run, "new_id long, old_id long, similarity double")
    w = Window.partitionBy("new_id").orderBy(F.desc("similarity"), F.asc_nulls_last("old_id"))
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def _alike(v: np.ndarray, ids: pa.Array, us: np.ndarray, new: np.ndarray, old: np.ndarray, width_us: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``new`` and ``old`` (masks) that belong together, and their cosine."""
    new, old = np.flatnonzero(new), np.flatnonzero(old)
    new, old = new[np.argsort(us[new], kind="stable")], old[np.argsort(us[old], kind="stable")]
    known, key = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    norm = _dots(v, v)
    same = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, CELLS // max(1, len(old)))
    for lo in range(0, len(new), step):
        a = new[lo : lo + step]
        near = old[np.searchsorted(us[old], us[a[0]] - width_us, "right") : np.searchsorted(us[old], us[a[-1]], "right")]
        s = unit[a] @ unit[near].T
        x, y = np.divmod(np.flatnonzero(s >= least - SLACK), max(1, len(near)))
        s = s[x, y]
        x, y = a[x], near[y]
        gap = us[x] - us[y]
        ok = (gap < width_us) & ((gap > 0) | (gap == 0) & known[x] & known[y] & (key[x] > key[y]))
        x, y, s = x[ok], y[ok], s[ok]
        # what is surely not among the best k isn't measured
        at = np.lexsort((-s, x))
        x, y, s = x[at], y[at], s[at]
        first = np.searchsorted(x, x)
        last = first + k - 1
        has = (last < len(x)) & (x[np.minimum(last, len(x) - 1)] == x)
        ok = ~has | (s >= s[np.where(has, last, 0)] - 2 * SLACK)
        x, y = x[ok], y[ok]
        # equal vectors are measured once
        _, one, of = np.unique(same[x] * len(v) + same[y], return_index=True, return_inverse=True)
        sim = np.concatenate([np.empty(0), *(_cosines(v, norm, x[one[q : q + 65536]], y[one[q : q + 65536]]) for q in range(0, len(one), 65536))])[of]
        ok = sim >= least
        x, y, sim = x[ok], y[ok], sim[ok]
        at = np.lexsort((key[y], -sim, x))
        x, y, sim = x[at], y[at], sim[at]
        ok = np.arange(len(x)) - np.searchsorted(x, x) < k
        out.append((x[ok], y[ok], sim[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _cosines(v: np.ndarray, norm: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.clip(_dots(v[x], v[y]) / np.sqrt(norm[x] * norm[y]), -1, 1), nan=-1.0)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products from first to last, each step rounded once as the SQL's engine does it (fused), so that near ties fall alike."""
    s = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for x, y in zip(a.T, b.T):
            p = x * y
            x1, y1 = _upper(x), _upper(y)
            err = ((x1 * y1 - p) + x1 * (y - y1) + (x - x1) * y1) + (x - x1) * (y - y1)
            t = p + s
            z = t - p
            whole = t + (((p - (t - z)) + (s - z)) + err)
            s = np.where(np.isfinite(whole), whole, t)
    return s


def _upper(x: np.ndarray) -> np.ndarray:
    c = x * 134217729.0
    return c - (c - x)
