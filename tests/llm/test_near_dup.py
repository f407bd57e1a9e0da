"""Near copies against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.functions.text import squeezed
from quaylight.llm import minhash as M
from quaylight.llm.near_dup import expanded_pairs, near_copies


def brute(rows, threshold=0.6):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None and len(squeezed(t)) >= 40:
            texts.setdefault(i, set()).add(squeezed(t))
    out = set()
    for a, b in combinations(sorted(texts), 2):
        for s in texts[a]:
            for t in texts[b]:
                p, q = M.shingle_set(s), M.shingle_set(t)
                if len(p & q) / len(p | q) >= threshold:
                    out.add((a, b))
    return out


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "msg long, txt string")
    if extra:
        df = df.withColumn("id", F.lit("x")).withColumn("rep", F.lit("y")).withColumn("digest", F.lit(1))
    return {tuple(r) for r in expanded_pairs(near_copies(df, "msg", F.col("txt"), 0.6)).collect()}


def sentences(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop甲乙丙丁戊") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(40):
        t = sentences(rng, rng.randint(8, 60))
        for c in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, len(w) // 4)):
                w[rng.randrange(len(w))] = sentences(rng, 1)
            out.append((len(out), " ".join(w) if c else t.upper() + "\n"))
    out += [(1000 + i, "  short text " * i) for i in range(4)] + [(2000, None), (2001, ""), (None, out[0][1])]
    return out + out[:20] + [(0, sentences(rng, 20))]


def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert len(want) > 60
    assert found(spark, rows) == want
    assert found(spark, rows, extra=True) == want


def test_hot_buckets_are_compared_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    hot = [(5000 + i, rows[0][1]) for i in range(60)]
    assert found(spark, rows + hot) == brute(rows + hot)


def test_empty_and_long(spark):
    assert found(spark, []) == set()
    long = sentences(random.Random(1), 6000)
    assert found(spark, [(1, long), (2, long[:-200] + "tail"), (3, long[: len(long) // 2])]) == {(1, 2)}


def test_squeezed_column(spark):
    from quaylight.llm.near_dup import squeezed_col

    texts = ["A b\tC\n", "\u3000甲 \xa0乙\x85\x1c\u2028ΑΣ ÀÉ\u200b", "", None, "ＡＢ 😀 X", " \x0b\x0c\r\u1680\u2009\u205f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(squeezed_col(F.col("t"))).collect()] == [None if t is None else squeezed(t) for t in texts]


def test_bucket_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 2)
    df = spark.createDataFrame([(k, i) for k in range(3) for i in range(3 * k)] + [(9, 1), (9, 1)], "key long, id long")
    assert {tuple(r) for r in M.bucket_pairs(df).collect()} == set(combinations(range(6), 2))


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    t = sentences(rng, 200)
    u = t[: len(t) * 2 // 3] + sentences(rng, 60)
    p, q = M.shingle_set(t), M.shingle_set(u)
    sig = M.signatures(*M.char_shingles([t, u, "abc", ""]))
    assert abs((sig[0] == sig[1]).mean() - len(p & q) / len(p | q)) < 0.12
    assert (sig[2] == 0xFFFFFFFF).all() and (sig[3] == 0xFFFFFFFF).all()
    h, b = M.char_shingles(["abcde", "", "xyz", "bcde"])
    assert b.tolist() == [0, 2, 2, 2, 3] and h[1] == h[2]
    assert np.array_equal(M.band_keys(sig[:1]), M.band_keys(sig[:1].copy()))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 30)]
    root = {v: v for e in edges for v in e}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    from quaylight.llm.near_dup import components

    got = {r.node: r.root for r in components(df).collect()}
    assert got == {v: top(v) for e in edges if e[0] != e[1] for v in e}
    assert components(df.where("false")).count() == 0


def test_classes(spark, rows):
    from quaylight.llm.near_dup import classes

    df = spark.createDataFrame(rows, "msg long, txt string")
    got = {r.msg: (r.class_id, r.links) for r in classes(near_copies(df, "msg", F.col("txt"), 0.6), df, "msg").collect()}
    pairs = brute(rows)
    assert set(got) == {i for i, _ in rows if i is not None}
    assert all(got[a][0] == got[b][0] for a, b in pairs)
    alone = set(got) - {i for p in pairs for i in p}
    assert all(got[i] == (i, 0) for i in alone)


def test_recall_of_the_bands_at_the_threshold():
    """Pairs of sets alike by exactly 0.6 share a band but for a few in a thousand."""
    import numpy as np

    from quaylight.llm import minhash

    rng, n = np.random.default_rng(7), 2000
    sets = []
    for _ in range(n):
        h = rng.integers(0, 2**64, 250, dtype=np.uint64)
        sets += [h[:200], np.concatenate([h[:150], h[200:]])]
    keys = minhash.band_keys(minhash.signatures(np.concatenate(sets), np.arange(2 * n + 1) * 200))
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.995
