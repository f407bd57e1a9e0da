"""Distrusted readings against a direct reading of the rules."""

import datetime as dt
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from quaylight.operators.spikes import Models, distrusted, fitted, score_readings, suspected

BOUNDS = {"hr": (25.0, 150.0)}
D0 = dt.date(2024, 1, 1)


def direct(rows):
    out = set()
    by = {}
    for s, d, x in set(rows):
        if x is not None and not np.isnan(x):
            by.setdefault(s, []).append((d, x))
    for s, r in by.items():
        r.sort()
        xs = [x for _, x in r]
        for i, (d, x) in enumerate(r):
            w = [y for e, y in r if abs((e - d).days) <= 30]
            m = median(w)
            mad = median(abs(y - m) for y in w)
            lo = hi = i
            while lo and xs[lo - 1] == x:
                lo -= 1
            while hi + 1 < len(xs) and xs[hi + 1] == x:
                hi += 1
            if x < 25 or x > 150 or (mad and abs(x - m) > 8 * mad + 1e-9) or hi - lo >= 4:
                out.add((s, d))
    return out


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "dev string, day date, hr double")
    if extra:
        df = df.withColumn("source", F.lit("s")).withColumn("metric", F.lit("m")).withColumn("value", F.lit(1))
    return {(r.source, r.day) for r in distrusted(score_readings(df, "dev", "day", BOUNDS)).collect()}


def test_against_direct(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(12):
        level = rng.uniform(45, 80)
        for k in range(700):
            if rng.random() < 0.1:
                continue
            x = float(np.round(level + rng.normal(0, 3), 1))
            u = rng.random()
            x = None if u < 0.05 else float("nan") if u < 0.06 else 0.0 if u < 0.065 else x + 60 if u < 0.08 else x
            rows.append((f"d{s}", D0 + dt.timedelta(days=k), x))
        for k in range(251, 261):  # a run over the border of two segments
            rows = [r for r in rows if r[:2] != (f"d{s}", D0 + dt.timedelta(days=k))] + [(f"d{s}", D0 + dt.timedelta(days=k), 55.5)]
    rows += rows[:50]
    want = direct(rows)
    assert len(want) > 100
    assert found(spark, rows) == want
    assert found(spark, rows, extra=True) == want


def test_edges(spark):
    assert found(spark, [("a", D0, 60.0)]) == set()
    assert found(spark, [("a", D0, 600.0)]) == {("a", D0)}
    assert found(spark, [("a", D0, None), (None, D0, 1.0)]) == set()
    df = spark.createDataFrame([], "dev string, day date, hr double")
    assert score_readings(df, "dev", "day", BOUNDS).count() == 0
    flat = [("a", D0 + dt.timedelta(days=i), 50.0) for i in range(4)]
    assert found(spark, flat) == set()
    assert len(found(spark, flat + [("a", D0 + dt.timedelta(days=9), 50.0)])) == 5


def test_two_readings_a_day(spark):
    rows = [("a", D0 + dt.timedelta(days=i), 50.0 + i % 3) for i in range(20)] + [("a", D0, 90.0)]
    assert found(spark, rows) == direct(rows)


def brute_forward_backward(m, like):
    """Of one series, by all paths of states."""
    from itertools import product

    from quaylight.operators.spikes import START

    t = len(like)
    p, moves = np.zeros((t, 4)), np.zeros((4, 4))
    for path in product(range(4), repeat=t):
        w = START[path[0]] * like[0, path[0]] * np.prod([m[i, j] * like[k + 1, j] for k, (i, j) in enumerate(zip(path, path[1:]))])
        for k, i in enumerate(path):
            p[k, i] += w
        for i, j in zip(path, path[1:]):
            moves[i, j] += w
    return p / p[0].sum(), moves / p[0].sum()


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    z, eq, no = rng.normal(0, 3, 10), rng.random(10) < 0.3, np.zeros(10, bool)
    of, pos = np.array([0] * 6 + [1] * 4), np.r_[np.arange(6), np.arange(4)]
    m = Models(2)
    m.moves = rng.dirichlet(np.ones(4), (2, 4))
    like, there = np.ones((2, 6, 4)), np.zeros((2, 6), bool)
    like[of, pos], there[of, pos] = m.likelihoods(z, eq, no, of), True
    p, moves = m.forward_backward(like, there)
    for i, n in ((0, 6), (1, 4)):
        want, want_moves = brute_forward_backward(m.moves[i], like[i, :n])
        assert np.allclose(p[i, :n], want) and np.allclose(moves[i], want_moves)


def test_each_source_has_a_model_of_its_own():
    """The same readings mean less where the source's own ways explain them, and more where it often jumps."""
    rng = np.random.default_rng(2)
    n = 240
    no = np.zeros(2 * n, bool)
    z = rng.normal(0, 1, 2 * n)
    z[n:][rng.random(n) < 0.2] *= 4
    z[[100, 101, 102, n + 100, n + 101, n + 102]] = [0.1, 3.3, -0.2] * 2
    of, pos = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    p, models = fitted(z, no, no, of, pos, 2)
    assert models.moves[1, 0, 1] > 3 * models.moves[0, 0, 1] and models.broad[1] < 10
    assert p[n + 101, 1] > p[101, 1] + 0.2
    # four equal readings: stuck for a source of fine readings, not for one of coarse readings
    equal = no.copy()
    equal[n:] = rng.random(n) < 0.4
    equal[95:110] = equal[n + 95 : n + 110] = False
    equal[100:104] = equal[n + 100 : n + 104] = True
    p, models = fitted(rng.normal(0, 1, 2 * n), equal, no, of, pos, 2)
    assert models.rate[1] > 5 * models.rate[0]
    assert p[100:104, 2].min() > 0.9 and p[n + 100 : n + 104, 2].max() < p[100:104, 2].min() - 0.1
    # a short series keeps to the common model
    short, common = fitted(z[99:104], no[:5], no[:5], np.zeros(5, int), np.arange(5), 1)
    assert np.allclose(common.moves[0], Models(1).moves[0], atol=0.03) and short[1, 0] > 0.9


def test_the_model_decides_on_its_own(spark):
    """No rule names the reading; without the model nothing would be found."""
    rng = np.random.default_rng(5)
    rows = [("a", D0 + dt.timedelta(days=i), 60 + float(np.round(rng.normal(0, 2), 2))) for i in range(120)]
    xs = sorted(x for _, _, x in rows[35:95])
    mad = median(abs(x - median(xs)) for x in xs)
    rows[65] = ("a", rows[65][1], float(np.round(median(xs) + 7.5 * mad, 2)))
    df = spark.createDataFrame(rows, "dev string, day date, hr double")
    scored = score_readings(df, "dev", "day", BOUNDS)
    assert {(r.day, r.state, r.ruled) for r in suspected(scored).collect()} == {(rows[65][1], "spike", False)}
    assert distrusted(scored).count() == 0 and direct(rows) == set()
    assert suspected(scored.withColumn("p_normal", F.lit(1.0))).count() == 0  # the model taken away


def test_a_run_across_far_segments(spark):
    days = [0, 300, 700, 1000, 1400]
    rows = [("a", D0 + dt.timedelta(days=d), 50.0) for d in days] + [("b", D0 + dt.timedelta(days=d), 50.0 + (d == 700)) for d in days]
    assert found(spark, rows) == {("a", D0 + dt.timedelta(days=d)) for d in days}


def test_a_run_counts_whatever_the_model_makes_of_it(spark):
    """The reading beyond a long gap has one equality as evidence, so the model may be sure of it."""
    rows = [(1, 0.99, True, False), (2, 0.99, False, False), (3, 0.5, False, True), (4, 0.99, False, True)]
    scored = spark.createDataFrame([(i, p, run, out, 60.0, 60.0, 2.0) for i, p, run, out in rows], "day int, p_normal double, run boolean, outside boolean, value double, median double, mad double")
    assert {r.day for r in distrusted(scored).collect()} == {1, 3}
