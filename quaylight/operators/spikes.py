"""Distrusted readings in per-source measurements.

A hidden Markov model with the states normal, spike, stuck and out of range runs
over each source's series of a metric.  What it observes of a reading is its
robust distance from the source's own centred median, whether it repeats a
neighbouring reading, and whether it lies outside hard bounds.  Each series has its own model: Baum-Welch fits
transitions, the spread of normal readings and of spikes, and how often normal and stuck readings repeat, drawn to the
common model by ``PRIOR`` readings' worth, so a short series keeps to it.  Forward-backward under the fitted model gives the
probability of each state, and ``suspected`` reads the states off; ``distrusted`` further holds them against stated rules.

The series are cut into segments of ``SEGMENT_DAYS`` days with a halo of days on both
sides, so a source of any length, and one that holds a third of all rows, is spread over
tasks of bounded size.  The halo covers the median's window; the posterior forgets its
start well within it.  Runs of equal readings skip missing days of any number, so each
segment also gets the few readings before and after it, taken from summaries of the
other segments.

Defined results: null and NaN readings and null days are no readings; rows that
occur twice in full count once; a source with one reading is normal unless out
of bounds; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.batches import whole_groups

SEGMENT_DAYS = 256
WINDOW_DAYS = 30
HALO_DAYS = 45
RUN = 5
MAD_FACTOR = 8.0
#: A reading less surely normal than this is a candidate.
SURE = 0.98
STATES = ("normal", "spike", "stuck", "out_of_range")

# rows: from, columns: to, in the order of STATES
TRANSITION = np.array([[0.97, 0.01, 0.01, 0.01], [0.62, 0.30, 0.04, 0.04], [0.08, 0.01, 0.90, 0.01], [0.56, 0.02, 0.02, 0.40]])
START = np.array([0.94, 0.02, 0.02, 0.02])
#: Readings' worth of the common model in each fit, and rounds of fitting.
PRIOR = 60.0
ROUNDS = 3
#: Spread of normal readings in robust deviations and of spikes; how often normal (its bounds) and stuck readings repeat.
SPREAD, BROAD = 1.0, 10.0
SPREADS, RATES = (0.5, 1.4), (0.01, 0.25)
STUCK_RATE = 0.98


def rolling_median_mad(grid: np.ndarray, half: int = WINDOW_DAYS) -> tuple[np.ndarray, np.ndarray]:
    """Centred median of each row's non-NaN cells, and their median distance from it."""
    n, t = grid.shape
    wide = np.full((n, t + 2 * half), np.nan)
    wide[:, half : half + t] = grid
    at_row, at_col = np.nonzero(~np.isnan(grid))
    med, mad = np.full((n, t), np.nan), np.full((n, t), np.nan)
    for lo in range(0, len(at_row), 65536):
        r, c = at_row[lo : lo + 65536], at_col[lo : lo + 65536]
        win = np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=1)[r, c]
        m = _middle(win)
        med[r, c], mad[r, c] = m, _middle(np.abs(win - m[:, None]))
    return med, mad


def _middle(rows: np.ndarray) -> np.ndarray:
    s = np.sort(rows, axis=1)  # NaN last
    k = (~np.isnan(s)).sum(axis=1)
    i = np.arange(len(s))
    return (s[i, (k - 1) // 2] + s[i, k // 2]) / 2


class Models:
    """One model for each of n series: transitions (n, 4, 4), spreads, broads, rates and stuck rates (n)."""

    def __init__(self, n: int, rates: np.ndarray | None = None):
        self.moves = np.tile(TRANSITION, (n, 1, 1))
        self.spread, self.broad = np.full(n, SPREAD), np.full(n, BROAD)
        self.rate = np.full(n, 0.05) if rates is None else rates
        self.stuck = np.full(n, STUCK_RATE)

    def likelihoods(self, z: np.ndarray, equal: np.ndarray, outside: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Emission densities of the four states; finite and positive everywhere.  ``of`` is each reading's series."""
        s, w, r, k = self.spread[of], self.broad[of], self.rate[of], self.stuck[of]
        bell = np.exp(-np.minimum((z / s) ** 2, 1000.0) / 2) / (s * np.sqrt(2 * np.pi)) + 1e-30
        broad = 1 / (np.pi * w * (1 + (z / w) ** 2))
        repeats = np.where(equal, r, 1 - r)
        return np.stack(
            [
                bell * repeats * np.where(outside, 1e-9, 1.0),
                broad * repeats * np.where(outside, 0.1, 1.0),
                (0.9 * bell + 0.1 * broad) * np.where(equal, k, 1 - k) * np.where(outside, 1e-3, 1.0),
                np.where(outside, 0.9, 1e-6) * np.full_like(z, 0.1),
            ],
            axis=-1,
        )

    def forward_backward(self, like: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State probabilities of padded series (``like`` is (series, time, state)), and expected moves (series, from, to)."""
        n, t, k = like.shape
        a, b = np.zeros_like(like), np.ones_like(like)
        cur = START * like[:, 0]
        cur = a[:, 0] = cur / cur.sum(1, keepdims=True)
        for i in range(1, t):
            nxt = np.matmul(cur[:, None], self.moves)[:, 0] * like[:, i]
            nxt /= nxt.sum(1, keepdims=True)
            cur = a[:, i] = np.where(there[:, i, None], nxt, cur)
        back = self.moves.transpose(0, 2, 1)
        nb = np.ones((n, k))
        for i in range(t - 1, 0, -1):
            seen = np.matmul((like[:, i] * nb)[:, None], back)[:, 0]
            seen /= seen.sum(1, keepdims=True)
            nb = b[:, i - 1] = np.where(there[:, i, None], seen, nb)
        p = a * b
        p /= p.sum(2, keepdims=True)
        ahead = (like * b)[:, 1:] * there[:, 1:, None]
        norm = np.einsum("nti,nij,ntj->nt", a[:, :-1], self.moves, ahead)
        ahead = ahead / np.where(norm > 0, norm, 1.0)[:, :, None]
        return p, np.einsum("nti,ntj->nij", a[:, :-1], ahead) * self.moves

    def refit(self, p: np.ndarray, moves: np.ndarray, z: np.ndarray, equal: np.ndarray, of: np.ndarray, share: np.ndarray) -> None:
        """Maximisation: expected counts with ``PRIOR`` readings of the common model.  ``share`` is each series' rate of repeats."""
        n = len(self.rate)
        total = lambda x: np.bincount(of, x, n)
        whole = moves + PRIOR * np.array([0.94, 0.02, 0.02, 0.02])[:, None] * TRANSITION
        self.moves = whole / whole.sum(2, keepdims=True)
        normal, spike, stuck = p[:, 0], p[:, 1], p[:, 2]
        self.spread = np.clip(np.sqrt((total(normal * np.minimum(z * z, 36.0)) + PRIOR * SPREAD**2) / (total(normal) + PRIOR)), *SPREADS)
        self.broad = (total(spike * np.minimum(np.abs(z), 100.0)) + PRIOR * 0.02 * BROAD) / (total(spike) + PRIOR * 0.02)
        self.rate = np.clip((total(normal * equal) + PRIOR * share) / (total(normal) + PRIOR), *RATES)
        self.stuck = np.clip((total(stuck * equal) + PRIOR * 0.02 * STUCK_RATE) / (total(stuck) + PRIOR * 0.02), 0.8, 0.99)


def fitted(z: np.ndarray, equal: np.ndarray, outside: np.ndarray, of: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, Models]:
    """State probabilities of readings under each series' own model, and the models.

    A reading is the ``pos``-th of series ``of``; equal, outside and z are what is observed of it.
    """
    t = int(pos.max()) + 1
    share = np.clip(np.bincount(of, equal, n) / np.maximum(np.bincount(of, minlength=n), 1), *RATES)
    models = Models(n, share)
    there = np.zeros((n, t), bool)
    there[of, pos] = True
    for i in range(ROUNDS + 1):
        like = np.ones((n, t, len(STATES)))
        like[of, pos] = models.likelihoods(z, equal, outside, of)
        p, moves = models.forward_backward(like, there)
        p = p[of, pos]
        if i < ROUNDS:
            models.refit(p, moves, z, equal, of, share)
    return p, models


def _neighbours(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of readings in order: whether one equals the one before or after it in its group, and its run's length."""
    n = len(x)
    new = np.ones(n, bool)
    new[1:] = (x[1:] != x[:-1]) | (group[1:] != group[:-1])
    run = np.cumsum(new) - 1
    length = np.bincount(run, minlength=1)[run] if n else np.empty(0, int)
    return length > 1, length


def _score(pdf: pd.DataFrame, bounds: dict[str, tuple[float, float]]) -> pd.DataFrame:
    """Medians, distances and state probabilities of whole segments.

    ``part``: 0 a reading of the segment, 1 of its halo, -1 and 2 one of the few before and after the segment.
    """
    pdf = pdf.sort_values(["source", "metric", "seg", "day_no", "value"], kind="stable", ignore_index=True)
    keys = pdf.groupby(["source", "metric", "seg"], sort=False).ngroup().to_numpy()
    part, x = pdf["part"].to_numpy(), pdf["value"].to_numpy(float)
    eq, long = np.zeros(len(pdf), bool), np.zeros(len(pdf), int)
    for at in (np.nonzero(part == 1)[0], np.nonzero(part != 1)[0]):
        if len(at):
            # the readings around a segment are numbered so that they sort to their places
            at = at[np.lexsort((at, np.sign(part[at] * (part[at] != 1)), keys[at]))]
            eq[at], long[at] = _neighbours(keys[at], x[at])
    use = (part == 0) | (part == 1)
    pdf, keys, x, eq, long = pdf[use].reset_index(drop=True), keys[use], x[use], eq[use], long[use]
    if len(pdf) == 0:
        return _empty()
    keys = np.unique(keys, return_inverse=True)[1]
    n = int(keys.max()) + 1
    day = pdf["day_no"].to_numpy(np.int64)
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, keys, day)
    col = day - first[keys]
    # a day with two unequal readings has no place on the grid of days
    if len(np.unique(keys * (int(col.max()) + 1) + col)) == len(col):
        grid = np.full((n, int(col.max()) + 1), np.nan)
        grid[keys, col] = x
        med, mad = rolling_median_mad(grid)
        m, d = med[keys, col], mad[keys, col]
    else:
        m, d = _slow_median_mad(keys, day, x)
    start = np.searchsorted(keys, np.arange(n))
    pos = np.arange(len(pdf)) - start[keys]
    lo, hi = (pdf["metric"].map({k: v[i] for k, v in bounds.items()}).to_numpy(float) for i in (0, 1))
    out = (x < lo) | (x > hi)
    z = np.where(d > 0, (x - m) / np.maximum(1.4826 * d, 1e-6), np.where(np.abs(x - m) > 0, 3.0, 0.0))
    p, _ = fitted(z, eq, out, keys, pos, n)
    res = pdf[["source", "day_no", "metric", "value"]].copy()
    res["outside"], res["run"], res["median"], res["mad"] = out, long >= RUN, m, d
    for i, name in enumerate(STATES):
        res[f"p_{name}"] = p[:, i]
    return res[pdf["part"].to_numpy() == 0]


def _empty() -> pd.DataFrame:
    return pd.DataFrame({c: [] for c in ["source", "day_no", "metric", "value", "outside", "run", "median", "mad", *[f"p_{s}" for s in STATES]]})


def _slow_median_mad(keys: np.ndarray, day: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, d = np.empty(len(x)), np.empty(len(x))
    for k in np.unique(keys):
        at = np.nonzero(keys == k)[0]
        for i in at:
            w = x[at[np.abs(day[at] - day[i]) <= WINDOW_DAYS]]
            m[i] = np.median(w)
            d[i] = np.median(np.abs(w - m[i]))
    return m, d


def score_readings(df: DataFrame, source: str, day: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row a reading: source, day, metric, value, outside, run, median, mad, p_* of each state.

    ``bounds`` names the metric columns with their least and greatest possible value.
    Full repeats are removed and segments summarised in one shuffle, by source, metric and segment; a second
    one brings each segment together with its halo.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in bounds)
    rows = df.where(F.col(day).isNotNull() & F.col(source).isNotNull()).select(
        F.col(source).alias("source"), F.unix_date(F.col(day).cast("date")).cast("long").alias("day_no"), whole.alias("row_hash"), F.expr(f"stack({len(bounds)}, {pairs}) as (metric, value)")
    )
    rows = rows.where("value is not null and not isnan(value)").withColumn("home", F.floor(F.col("day_no") / SEGMENT_DAYS))
    rows = rows.repartition("source", "metric", "home").dropDuplicates(["source", "metric", "home", "day_no", "value", "row_hash"])
    # the few readings around each segment
    few = RUN - 1
    order = F.array_sort(F.collect_list(F.struct("day_no", "value")))
    edges = rows.groupBy("source", "metric", "home").agg(order.alias("all")).select("source", "metric", "home", F.slice("all", 1, few).alias("head"), F.slice(F.reverse("all"), 1, few).alias("tail"))
    w = Window.partitionBy("source", "metric").orderBy("home")
    before = F.flatten(F.reverse(F.collect_list("tail").over(w.rowsBetween(-few, -1))))
    after = F.flatten(F.collect_list("head").over(w.rowsBetween(1, few)))
    marked = lambda side, part: F.transform(F.slice(side, 1, few), lambda e: F.struct(e["day_no"].alias("day_no"), e["value"].alias("value"), F.lit(part).alias("part")))
    edges = edges.select("source", "metric", F.col("home").alias("seg"), before.alias("b"), after.alias("a"))
    around = edges.select("source", "metric", "seg", F.explode(F.concat(marked("b", -1), marked("a", 2))).alias("e")).select("source", "metric", "seg", "e.*")
    halo = F.explode(F.array_distinct(F.array(*[F.floor((F.col("day_no") + h) / SEGMENT_DAYS) for h in (-HALO_DAYS, 0, HALO_DAYS)])))
    spread = rows.select("source", "metric", halo.alias("seg"), "day_no", "value", "home").select("source", "metric", "seg", "day_no", "value", F.when(F.col("seg") == F.col("home"), 0).otherwise(1).alias("part"))
    spread = spread.unionByName(around)
    spread = spread.repartition("source", "metric", "seg").sortWithinPartitions("source", "metric", "seg")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["source", "metric", "seg"]):
            yield _score(pdf, bounds)

    probs = ", ".join(f"p_{s} double" for s in STATES)
    out = spread.mapInPandas(score, f"source string, day_no long, metric string, value double, outside boolean, run boolean, median double, mad double, {probs}")
    return out.withColumn("day_no", F.date_from_unix_date(F.col("day_no").cast("int"))).withColumnRenamed("day_no", "day")


def suspected(scored: DataFrame) -> DataFrame:
    """Readings whose most probable state isn't normal, with ``state`` and ``ruled``: whether a stated rule names them too.

    The model alone decides: it sees deviations below the rules' factor that are odd for their source, and lets pass
    what a rule names but the source's own ways explain.
    """
    best = F.greatest(*[f"p_{s}" for s in STATES])
    state = F.coalesce(*[F.when(F.col(f"p_{s}") == best, s) for s in STATES])
    return scored.withColumns({"state": state, "ruled": ruled()}).where("state <> 'normal'")


def ruled() -> Column:
    """Whether a reading breaks a stated rule: outside the bounds, too far from the median, or in a run.

    Floating noise in the product decides nothing: a margin of 1e-9 is on the side of trust.
    """
    far = (F.col("mad") > 0) & (F.abs(F.col("value") - F.col("median")) > MAD_FACTOR * F.col("mad") + 1e-9)
    return F.col("outside") | far | F.col("run")


def distrusted(scored: DataFrame) -> DataFrame:
    """Readings the model distrusts that also fail a stated rule; a run is one whatever the model makes of it.

    The rules: outside the hard bounds; further than ``MAD_FACTOR`` median distances
    from the median (where that distance isn't 0); one of ``RUN`` equal readings in a row.
    The model sees a segment and its halo only, while a run goes on over a gap of any length.
    """
    return scored.where(((F.col("p_normal") < SURE) | F.col("run")) & ruled())
