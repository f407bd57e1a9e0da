"""Near copies by circulant MinHash.

The universe of shingle hashes is mapped onto ``D`` cells (the first permutation); a
second permutation of the cells, shifted round by k places, gives signature coordinate k.
The shifted reads of one shingle are ``K`` consecutive entries of one table, so a
signature is the running minimum of contiguous slices.

``ROWS`` coordinates make a band and two texts that share a band are candidates.
Candidates pass a sketch of one bit a coordinate, then an exact check.

Exact copies are folded into one representative first, so a text repeated in a third of all
rows is one row from there on.  Buckets are counted first (partial counts, then one row a key); the
rows of a full one get blocks by a hash of their id, about ``BLOCK`` rows each, and every pair of
blocks is a group of its own: all pairs are seen, no task sorts or holds a bucket.  Sketches travel
with the rows, so far pairs end inside their group and never reach a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.session import materialize

D = 1 << 20
#: A pair alike by 0.6 shares no band with probability (1 - 0.6 ** 4) ** 80 = 0.000015.
BANDS, ROWS = 80, 4
K = BANDS * ROWS
SKETCH_BITS = 256
#: Columns of the sketch.
SKETCH = tuple(f"s{i}" for i in range(SKETCH_BITS // 64))
BLOCK = 128
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """Row v: coordinates 0..K-1 of cell v."""
    pi = np.random.default_rng(20240101).permutation(D).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: K - 1]]), K)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def char_shingles(texts: list[str], size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` characters of all texts, and each text's bounds in them."""
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(n)
    if len(codes) < size:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = sum(codes[i : len(codes) - size + 1 + i] * _ODD[i] for i in range(size))
    keep = np.ones(len(h), bool)
    for i in range(1, size):  # runs that begin at a text's last characters reach into the next
        at = end - i
        at = at[(at >= np.maximum(end - n, 0)) & (at < len(h))]
        keep[at] = False
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.maximum(n - size + 1, 0), out=bounds[1:])
    return mix(h[keep]), bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signature of each text; a text without shingles has the greatest values."""
    table = _shifts()
    cell = (hashes >> np.uint64(44)).astype(np.int64)
    out = np.full((len(bounds) - 1, K), 0xFFFFFFFF, np.uint32)
    for i in range(len(out)):
        for lo in range(bounds[i], bounds[i + 1], 4096):
            np.minimum(out[i], table[cell[lo : min(lo + 4096, bounds[i + 1])]].min(axis=0), out=out[i])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; bands differ in their keys' last step, so no column of band numbers is needed."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        h = mix(h + s[:, :, j] * _ODD[j] + _ODD[5])
    return mix(h ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[6])).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first ``SKETCH_BITS`` coordinates, as 64-bit numbers."""
    return np.packbits((sig[:, :SKETCH_BITS] >> 3) & 1, axis=1).view(np.int64)


def least_agreement(similarity: float) -> int:
    """Sketch bits that texts of that similarity share but for five standard errors (3 in ten million)."""
    p = (1 + similarity) / 2
    return int(SKETCH_BITS * p - 5 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def sign(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, bands (array of long) and the sketch's columns for each text."""
    kept = texts.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                sig = signatures(*char_shingles(c.column(1).to_pylist()))
                sk = sketches(sig)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sig).ravel()))
                yield pa.RecordBatch.from_arrays([c.column(0), bands, *(pa.array(np.ascontiguousarray(x)) for x in sk.T)], names=[key, "bands", *SKETCH])

    return texts.select(key, text).mapInArrow(run, f"{key} {kept.dataType.simpleString()}, bands array<bigint>" + "".join(f", {x} bigint" for x in SKETCH))


def signed_rows(rows: DataFrame, text: str, bands: str) -> DataFrame:
    """All columns of ``rows`` with ``bands`` (array of long) and the sketch's columns, null where the text is; no shuffle."""
    at = rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(bands, T.ArrayType(T.LongType())), *(T.StructField(x, T.LongType()) for x in SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                texts = c.column(at).to_pylist()
                none = np.array([t is None for t in texts])
                sig = signatures(*char_shingles([t or "" for t in texts]))
                keys, sk = band_keys(sig), sketches(sig)
                lists = pa.array([None if x else k for x, k in zip(none, keys)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*c.columns, lists, *(pa.array(x.copy(), mask=none) for x in sk.T)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _numbered(rows: DataFrame, block: int, opened: bool) -> DataFrame:
    """Rows of keys that several hold, with their block of it: own (of ``blocks``); with ``opened``, blocks among the open rows too.

    Keys are counted by partial aggregation; a row's block is a hash of its id, so no window sorts a key.  The
    join of rows with counts splits a hot key by the adaptive skew handling, since the side of the counts has one row a key.
    """
    aggs = [F.count("*").alias("n")] + ([F.count_if("open").alias("m")] if opened else [])
    counts = rows.groupBy("key").agg(*aggs).where("n > 1 and m > 0" if opened else "n > 1")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    n = rows.join(counts, "key").withColumn("blocks", blocks("n")).withColumn("hash", F.xxhash64("id"))
    if opened:
        n = n.withColumn("open_blocks", blocks("m"))
    return n


def _block(c: str) -> Column:
    return F.pmod("hash", F.col(c)).cast("int")


def bucket_pairs(rows: DataFrame, block: int | None = None, least: int | None = None) -> DataFrame:
    """Distinct pairs a < b of ids that share a key, of rows (key, id), with or without the sketch's columns.

    With sketches only pairs that agree in ``least`` bits; a row without sketch (null) agrees with all.
    """
    block = block or BLOCK
    sk = [c for c in rows.columns if c not in ("key", "id")]
    n = _numbered(rows, block, False).select("key", "id", *sk, _block("blocks").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    n = n.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("own", "id", *sk)).alias("l"))
    p = n.select("i", "j", F.explode("l").alias("x"), "l").select("i", "j", "x", F.explode("l").alias("y"))
    p = p.where("(i = j and x.id < y.id) or (i < j and x.own = i and y.own = j)")
    if least is not None:
        p = p.where(F.coalesce(agreement([F.col(f"x.{c}") for c in SKETCH], [F.col(f"y.{c}") for c in SKETCH]) >= least, F.lit(True)))
    return p.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).where("a < b").distinct()


def bucket_pairs_from(rows: DataFrame, block: int | None = None) -> DataFrame:
    """Distinct pairs a, b of different ids that share a key, a of the rows marked ``open``, of rows (key, id, open).

    As in ``bucket_pairs`` no task holds a bucket: blocks of open rows meet blocks of all rows.  Buckets without an open row end before that.
    """
    n = _numbered(rows, block or BLOCK, True)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = n.where("open").select("key", "id", F.lit(True).alias("left"), _block("open_blocks").alias("i"), upto("blocks").alias("j"))
    right = n.select("key", "id", F.lit(False).alias("left"), upto("open_blocks").alias("i"), _block("blocks").alias("j"))
    g = left.unionByName(right).groupBy("key", "i", "j").agg(F.collect_list(F.when(F.col("left"), F.col("id"))).alias("l"), F.collect_list(F.when(~F.col("left"), F.col("id"))).alias("r"))
    return g.select(F.explode("l").alias("a"), "r").select("a", F.explode("r").alias("b")).where("a <> b").distinct()


def agreement(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two sketches agree."""
    return F.lit(SKETCH_BITS) - sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def shingle_set(s: str, size: int = 4) -> frozenset:
    return frozenset(s[i : i + size] for i in range(len(s) - size + 1))


def similarity(a: Column, b: Column, size: int = 4) -> Column:
    """Exact Jaccard similarity of the sets of runs of ``size`` characters; 0 where either is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        sets: dict[str, frozenset] = {}
        out = np.zeros(len(x))
        for i, (s, t) in enumerate(zip(x.tolist(), y.tolist())):
            if s is None or t is None:
                continue
            for u in (s, t):
                if u not in sets:
                    if len(sets) > 4096:
                        sets.clear()
                    sets[u] = shingle_set(u, size)
            p, q = sets.get(s) or shingle_set(s, size), sets.get(t) or shingle_set(t, size)
            k = len(p & q)
            out[i] = k / max(1, len(p) + len(q) - k)
        return pd.Series(out)

    return run(a, b)


def verified_links(reps: DataFrame, threshold: float) -> DataFrame:
    """Links a < b, similarity of representatives (id, squeezed) alike beyond the threshold.

    ``reps`` must be materialised: it is read for signing and for the check.
    """
    signed = materialize(sign(reps, "id", "squeezed"), "signed")
    cand = bucket_pairs(signed.select(F.explode("bands").alias("key"), "id", *SKETCH), least=least_agreement(threshold))
    t = reps.select("id", "squeezed")
    cand = cand.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
    return cand.select("a", "b", similarity(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= threshold)
